"""doclens.streaming"""

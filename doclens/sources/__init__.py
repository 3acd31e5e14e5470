"""doclens.sources"""

"""doclens.operators"""

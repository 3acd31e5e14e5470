"""doclens.functions"""

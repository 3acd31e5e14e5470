"""doclens.plans"""

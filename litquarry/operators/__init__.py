"""litquarry.operators"""

"""litquarry.streaming"""

"""litquarry.sources"""

"""litquarry.functions"""

"""litquarry.plans"""

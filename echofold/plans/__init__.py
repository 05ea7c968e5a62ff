"""echofold.plans"""

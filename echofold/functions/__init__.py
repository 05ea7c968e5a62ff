"""echofold.functions"""

"""echofold.sources"""

"""echofold.streaming"""

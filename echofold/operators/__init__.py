"""echofold.operators"""

"""patchloom.operators"""

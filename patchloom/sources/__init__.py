"""patchloom.sources"""

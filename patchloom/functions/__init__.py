"""patchloom.functions"""

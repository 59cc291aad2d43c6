"""quillon.streaming"""

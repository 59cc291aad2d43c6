"""quillon.sources"""

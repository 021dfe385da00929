"""larder.sources"""

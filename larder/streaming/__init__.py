"""larder.streaming"""

"""larder.functions"""

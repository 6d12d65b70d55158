"""finstmt.streaming"""

"""finstmt.sources"""

"""finstmt.operators"""

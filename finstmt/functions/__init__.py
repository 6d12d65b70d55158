"""finstmt.functions"""

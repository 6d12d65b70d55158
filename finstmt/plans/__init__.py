"""finstmt.plans"""

"""actlens.plans"""

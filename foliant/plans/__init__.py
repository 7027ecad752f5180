"""foliant.plans"""

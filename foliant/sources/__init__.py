"""foliant.sources"""

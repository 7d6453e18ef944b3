"""phonolith.plans"""

"""phonolith.operators"""

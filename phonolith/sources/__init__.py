"""phonolith.sources"""

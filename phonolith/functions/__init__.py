"""phonolith.functions"""

"""tripwire.sources"""

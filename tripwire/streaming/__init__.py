"""tripwire.streaming"""

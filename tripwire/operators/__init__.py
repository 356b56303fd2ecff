"""tripwire.operators"""

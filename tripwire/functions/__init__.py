"""tripwire.functions"""

"""tripwire.plans"""

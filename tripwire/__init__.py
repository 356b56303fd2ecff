"""tripwire — Spark-native data engine for backdoor-robustness studies.

Plain functions ``DataFrame -> DataFrame`` grouped by concern:

* ``tripwire.sources``   — task files, dimensions, result/metric readers and writers
* ``tripwire.functions`` — scalar Column helpers (strip, hashing, labels, verdicts)
* ``tripwire.operators`` — text rewrites, seeded sampling, scoring, metrics
* ``tripwire.plans``     — end-to-end plans (experiment grid, repair, analysis)
* ``tripwire.streaming`` — the row-local operators on ``readStream`` input
"""

from tripwire.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]

"""What has been tried, kept as keyed state: each content key is worked on until it succeeds, a bounded number of times.

The state, which a checkpoint keeps over restarts, says of each key whether it is done and
how often it was tried. A key that comes again is skipped if it is done, tried again if
it has failed, and given up after ``most`` tries.

Keys are dealt by their hash to a fixed number of buckets, each of which is a key of Spark's state, so that
a call of Python takes a bucket's keys and not a single one. A batch writes the state of the buckets it meets anew,
each of the number of all keys over that of buckets; the number stays for the life of a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "key string, status string, tries int, result string"
STATE = "keys array<string>, done array<boolean>, tries array<int>"
BUCKETS = 1 << 14


def attempts(stream: DataFrame, work: Callable[[pd.Series], str], most: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """One row for each key (column ``key``) of each batch: done, failed, skipped or given up, its tries so far, and what ``work`` gave for its row.

    ``work`` gets one row of a key and runs in the task; its errors count as failures. Rows of a key
    that come in one batch are one. Use it with the output mode ``update``.
    """

    def tried(row: pd.Series) -> tuple[str, bool]:
        try:
            return work(row), True
        except Exception as e:  # noqa: BLE001  (a failure is a result here)
            return f"{type(e).__name__}: {e}", False

    def step(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {key: (done, tries) for key, done, tries in zip(*state.get, strict=True)} if state.exists else {}
        met, changed = {}, False
        for some in rows:
            some = some.drop(columns="__bucket")
            for k, key in enumerate(some["key"].tolist()):
                if key in met:
                    continue
                done, tries = known.get(key, (False, 0))
                if done or tries >= most:
                    met[key] = ("skipped" if done else "given up", tries, None)
                    continue
                result, done = tried(some.iloc[k])
                known[key], changed = (done, tries + 1), True
                met[key] = ("done" if done else "failed", tries + 1, result)
        if changed:
            state.update((list(known), [done for done, _ in known.values()], [tries for _, tries in known.values()]))
        status, tries, result = zip(*met.values(), strict=True)
        yield pd.DataFrame({"key": list(met), "status": status, "tries": tries, "result": result})

    dealt = stream.withColumn("__bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("__bucket").applyInPandasWithState(step, OUTCOME, STATE, "update", GroupStateTimeout.NoTimeout)

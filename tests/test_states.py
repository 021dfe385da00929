"""State machines as streams give what one batch gives, for any split of the log."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import kitchen
from larder.streaming import states


@pytest.fixture
def store(spark):
    before = spark.conf.get(states.STORE[0])
    spark.conf.set(*states.STORE)
    yield
    spark.conf.set(states.STORE[0], before)


def run(spark, stream, mode, name, folder):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    query.stop()
    return spark.table(name).collect()


@pytest.mark.parametrize("files", [1, 4])
def test_friends(spark, store, tmp_path, files):
    rng = random.Random(files)
    log = [(i, *rng.sample(range(8), 2), rng.choice(["pending", "pending", "accepted"]), f"2024-01-{rng.randrange(1, 9):02d} 10:00:00") for i in range(40)]
    rng.shuffle(log)
    schema = "id long, requester long, addressee long, status string, created_at string"
    for k in range(files):
        spark.createDataFrame(log[k::files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}
    for r in run(spark, states.friend_states(stream), "update", f"friends{files}", tmp_path):
        pair = frozenset((r.requester, r.addressee))
        if pair not in last or last[pair].n < r.n:
            last[pair] = r
    want = {}
    for i, a, b, status, at in log:
        want.setdefault(frozenset((a, b)), []).append((at, i, a, b, status))
    for pair, asked in want.items():
        at, _, a, b, _ = min(asked)
        accepted = len({x[2] for x in asked}) == 2 or any(x[4] == "accepted" for x in asked)
        assert tuple(last[pair])[:4] == (a, b, at, "accepted" if accepted else "pending")
        assert last[pair].n == len(asked)
    assert len(last) == len(want)


def test_signups(spark, store, tmp_path):
    rng = random.Random(5)
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    invites = [("invite", None, f"c{k}", at(0), k == 1, at(40) if k == 2 else None) for k in range(4)]
    signups = [("signup", i, f"c{rng.randrange(6)}", at(rng.randrange(1, 90)), None, None) for i in range(40)]
    rng.shuffle(signups)
    schema = "kind string, id long, code string, at string, used boolean, expires_at string"
    batches = [invites + signups[:10], signups[10:30], signups[30:], [("invite", None, "end", "2024-01-03 00:00:00", False, None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(f"{schema}, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("at"))
    got = {r.id: r.refusal for r in run(spark, states.signup_outcomes(stream, "3 hours"), "append", "signups", tmp_path)}
    known = spark.createDataFrame([(c, u, e) for _, _, c, _, u, e in invites], "code string, used boolean, expires_at string")
    asked = spark.createDataFrame([(i, c, a) for _, i, c, a, _, _ in signups], "id long, code string, at string")
    want = {r.id: r.refusal for r in kitchen.consume_invites(asked, known).collect()}
    assert got == want and None in want.values() and {"used", "expired", "no such invite"} <= set(want.values())

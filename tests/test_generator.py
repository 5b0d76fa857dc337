"""Model calls with budgets: slow, failing, recovering and good ones, at once."""

import asyncio
import time

import pytest
from pyspark.sql import functions as F

from tarnlake.functions.registry import answered, concurrent_generator


def service(waits=0.1):
    tries: dict = {}

    def model(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if prompt.startswith("slow"):
            time.sleep(30)
        if prompt.startswith("bad") or (prompt.startswith("shy") and tries[prompt] < 3):
            raise ValueError("no")
        time.sleep(waits)
        return f"re: {prompt}"

    return model


@pytest.mark.parametrize("kind", ["plain", "asynchronous"])
def test_budgets(kind):
    model = service(0.05)
    if kind == "asynchronous":
        inner = model

        async def model(prompt):
            await asyncio.sleep(30 if prompt.startswith("slow") else 0)
            return inner(prompt)

    prompts = ["good", "slow", "bad", "shy", None, "slow too"]
    began = time.monotonic()
    got = asyncio.run(answered(model, prompts, "sorry", 3, 0.5, 1.2, 3))
    assert time.monotonic() - began < 5
    assert got[0] == ("re: good", None, 1) and got[3] == ("re: shy", None, 3) and got[4] == ("sorry", "no prompt", 0)
    assert got[2] == ("sorry", "ValueError: no", 4)
    assert got[1][0] == "sorry" and got[1][1] == "out of time: timed out" and got[1][2] == 3 == got[5][2]  # 0.5 + 0.5 + 0.2 seconds


def test_calls_run_at_once_in_a_task(spark):
    df = spark.range(40, numPartitions=1).select(F.when(F.col("id") < 39, F.concat(F.lit("good "), F.col("id") % 32)).alias("p"))
    run = concurrent_generator(lambda: service(0.4), "sorry", concurrent=16)
    df.limit(1).select(run("p")).collect()  # the worker is up
    began = time.monotonic()
    rows = df.select("p", run("p").alias("g")).select("p", "g.*").collect()
    assert time.monotonic() - began < 8  # 32 different prompts one by one would take 13 seconds
    assert all((r.answer, r.error, r.calls) == (f"re: {r.p}", None, 1) for r in rows if r.p) and [r.error for r in rows if not r.p] == ["no prompt"]

"""Seeded random logs: window forms against a direct per-row brute force."""

import random

from clickwright.operators import sequence as seq


def brute(rows, seconds=600):
    out = {}
    for rid, user, shop, ts in rows:
        same = [r for r in rows if r[1] == user]
        bf = sum(1 for r in same if 0 < r[3] - ts < seconds)
        af = sum(1 for r in same if -seconds < r[3] - ts < 0)
        earlier = [r[3] for r in same if r[2] == shop and r[3] < ts]
        view = float(ts - max(earlier)) if earlier else -1.0
        order = sorted(same, key=lambda r: (r[3], r[0]))
        pos = [r[0] for r in order].index(rid)
        last = ts - order[pos - 1][3] if pos > 0 else -1
        nxt = order[pos + 1][3] - ts if pos + 1 < len(order) else -1
        out[rid] = (float(bf), float(af), view, last, nxt)
    return out


def run_features(df, bucket):
    from clickwright.operators.sequence import ordered_key_features

    df = ordered_key_features(df, ["user_id"], rolling=("user", 600), last_gap="user_id_lasttime_diff",
                              next_gap="user_id_nexttime_diff", bucket_seconds=bucket)
    return ordered_key_features(df, ["user_id", "shop_id"], last_view="diffWithLastView_shop_id", bucket_seconds=bucket)


def test_random_logs_match_bruteforce_small_buckets(spark):
    rnd = random.Random(11)
    rows = [(rid, rnd.randint(1, 4), rnd.choice("AB"), rnd.randint(0, 9000)) for rid in range(300)]
    df = spark.createDataFrame(rows, "instance_id bigint, user_id bigint, shop_id string, context_timestamp bigint")
    expected = brute(rows)
    for bucket in (600, 1000, 2500):
        out = run_features(df, bucket)
        got = {
            r["instance_id"]: (r["user_count_10_bf"], r["user_count_10_af"], r["diffWithLastView_shop_id"],
                               r["user_id_lasttime_diff"], r["user_id_nexttime_diff"])
            for r in out.collect()
        }
        assert got == expected, bucket


def test_random_logs_match_bruteforce(spark):
    rnd = random.Random(7)
    rows = []
    for rid in range(400):
        rows.append((rid, rnd.randint(1, 6), rnd.choice("ABC"), rnd.randint(0, 4000) // rnd.choice([1, 7, 30]) * 7))
    df = spark.createDataFrame(rows, "instance_id bigint, user_id bigint, shop_id string, context_timestamp bigint")
    df = seq.rolling_neighbor_counts(df, {"user": ["user_id"]})
    df = seq.gap_to_last_view(df, ["shop_id"])
    df = seq.last_time_gap(df, ["user_id"])
    df = seq.next_time_gap(df, ["user_id"])
    got = {
        r["instance_id"]: (r["user_count_10_bf"], r["user_count_10_af"], r["diffWithLastView_shop_id"],
                           r["user_id_lasttime_diff"], r["user_id_nexttime_diff"])
        for r in df.collect()
    }
    assert got == brute(rows)

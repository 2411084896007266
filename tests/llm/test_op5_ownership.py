"""A value that a single owner holds is live-looking in however many documents."""

import hashlib
import random

from tempograin.llm import op5_secrets


def test_one_owner_with_many_documents(spark):
    value, shared = "Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"
    rows = [(i, f'x = "{value}" token=abcdef12', "s1") for i in range(50)] + [(100 + i, f'x = "{shared}"', f"s{i}") for i in range(2)]
    made = {r["doc_id"]: r for r in op5_secrets.digest(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all("other:5:29" in made[i]["spans"].split(",") and (made[i]["n_live"], made[i]["n_copied"]) == (1, 0) for i in range(50))
    assert made[100]["spans"] == made[101]["spans"] == ""


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(40)) + "Aa1Bb2Cc3Dd4" for _ in range(12)]
    rows = []
    for i in range(200):
        own = rng.sample(range(4), rng.randrange(2)) if i % 2 else rng.sample(range(4, 12), rng.randrange(3))
        rows.append((i, " ".join([f'x = "{values[v]}"' for v in own] + [f"token={values[v]}" for v in own[:1]]), rng.choice([None, "a", "b"]) if any(v > 3 for v in own) else "c", rng.choice([None, "en", "de"]), own))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, source string, lang string")
    holders = {v: [(r[2], r[3], r[0]) for r in rows if v in r[4]] for v in range(12)}
    found = {bytes(r["hash"]): (r["n_owners"], r["n_repositories"], r["n_documents"], r["live"]) for r in op5_secrets.ownership(op5_secrets.scan(docs)).collect()}
    for v, held in holders.items():
        owners = {h[0] for h in held}
        assert found[hashlib.sha256(values[v].encode()).digest()] == (len(owners), len({h[:2] for h in held}), len(held), len(owners) == 1)
    live = {v for v, held in holders.items() if len({h[0] for h in held}) == 1}
    assert live and len(live) < 12
    for r in op5_secrets.digest(docs).collect():
        own = rows[r["doc_id"]][4]
        # the first value is assigned too, so its token there is part of a base span; where it stands alone it is added if live
        assert sum(x.startswith("other:") for x in r["spans"].split(",")) == sum(v in live for v in own)
        assert (r["n_live"], r["n_copied"]) == (sum(v in live for v in own[:1]), sum(v not in live for v in own[:1]))

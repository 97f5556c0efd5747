"""Conversation repair against all possible edits, a plain program over whole conversations, and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from dimtrail.llm import conversations as cv
from dimtrail.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
ROLES = ["user", "assistant", "system", "tool", "", " ", "User"]


def every_edit(rows):
    """Least (cost, audit) with its repaired rows, over all edits with up to two rows put in at a place. rows: (role, fault, text)."""
    best = None
    gaps = list(itertools.chain.from_iterable(itertools.product(("user", "assistant"), repeat=n) for n in range(3)))
    own = []
    for role, fault, text in rows:
        choices = [("D", None, 2)]
        if fault not in (cv.BLANK, cv.DUPLICATE):
            late = 5 * (fault == cv.TRUNCATED)
            choices += [("K", (role, text), late), ("R", ("user", text), 1 + late), ("R", ("assistant", text), 1 + late)]
        own.append(choices)
    for picked in itertools.product(*own):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(p[2] for p in picked) + 5 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            audit, kept = "I" * len(put[0]), [(r, "") for r in put[0]]
            for p, g in zip(picked, put[1:], strict=True):
                audit += p[0] + "I" * len(g)
                kept += ([p[1]] if p[1] else []) + [(r, "") for r in g]
            if all(r for r, _ in kept) and PATTERN.fullmatch("".join(r[0] for r, _ in kept)):
                best = min(best, (cost, audit, kept)) if best else (cost, audit, kept)
    return best[0], best[1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()


def plain(rows):
    """A second, plain program with whole strings; rows: (role, fault, text)."""
    states = {0: (0, "", ())}
    put = {"u": "user", "a": "assistant"}
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def relaxed(states):
        for _ in range(3):
            for (p, c), q in steps.items():
                if p in states and c in put:
                    cost, audit, kept = states[p]
                    states[q] = min(states.get(q, (9e9,)), (cost + 5, audit + "I", (*kept, (put[c], ""))))
        return states

    for role, fault, text in rows:
        states, new = relaxed(states), {}
        late = 5 * (fault == cv.TRUNCATED)
        for p, (cost, audit, kept) in states.items():
            made = [(p, 2, "D", kept)]
            if fault not in (cv.BLANK, cv.DUPLICATE):
                made += [(steps[p, role[:1]], late, "K", (*kept, (role, text)))] if (p, role[:1]) in steps else []
                made += [(steps[p, c], 1 + late, "R", (*kept, (put[c], text))) for c in put if (p, c) in steps]
            for q, more, letter, then in made:
                new[q] = min(new.get(q, (9e9,)), (cost + more, audit + letter, then))
        states = new
    cost, audit, kept = min(v for p, v in relaxed(states).items() if p in (0, 3))
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def found(rows, **options):
    repair = cv.Repair(**options)
    for r in rows:
        repair.row(*r)
    return repair.finish()


@pytest.mark.parametrize("seed", range(40))
def test_against_every_edit(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(ROLES), rng.randrange(4), f"t{k}") for k in range(seed % 4)]
    assert found(rows) == plain(rows) == every_edit(rows)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 1, 2, 5])
def test_against_plain_strings(modulus):
    """Also with hashes that collide all the time."""
    rng = random.Random(modulus)
    for n in [0, 1, 2, 5, 9, 30, 80] * 12:
        roles = rng.choice([ROLES, ROLES[:2], ["user"], ["assistant"], ["system"], ["tool"]])
        rows = [(rng.choice(roles), rng.choices(range(4), (6, 1, 1, 1))[0], f"t{k}") for k in range(n)]
        assert found(rows, modulus=modulus) == plain(rows)


def test_order_of_prefixes():
    rng = random.Random(3)
    for modulus in ((1 << 61) - 1, 1, 3):
        tree, texts = cv.Prefixes(modulus), [""]
        for _ in range(300):
            node = rng.randrange(len(texts))
            letter = rng.choice("DIKR")
            assert tree.add(node, letter) == len(texts)
            texts.append(texts[node] + letter)
        for _ in range(3000):
            a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
            assert tree.less(a, b) == (texts[a] < texts[b])
            low = tree.shared([a, b])
            assert tree.text(a, low) == texts[a][len(texts[low]) :] and texts[b].startswith(texts[low])


def test_long_conversations_are_written_out():
    rng = random.Random(8)
    rows = [(("user", "assistant")[k % 2] if rng.random() < 0.9 else rng.choice(ROLES), rng.choices(range(4), (9, 1, 1, 1))[0], f"t{k}") for k in range(6000)]
    repair = cv.Repair()
    for r in rows:
        repair.row(*r)
    assert repair.written and len(repair.prefixes.letter) < 20000
    assert repair.finish() == plain(rows)


def plain_audits(rows):
    """All columns by conversation, from damage on."""
    text = lambda v: " " if v is None else str(v)
    made = {r[0]: [] for r in rows}
    for conv, turn, role, body in rows:
        how = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        if how:
            body = "" if how == 1 else re.sub("[.!?]", "", body) if how == 2 else body
            made[conv] += [(turn, "user" if how == 4 else role, body)] * (1 + (how == 3))
    out = []
    for conv, own in made.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, body in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", body)
            faults.append(1 if not shown else 2 if (role, body) in seen else 3 if shown[-1] not in ".!?" else 0)
            seen.add((role, body))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, *plain([(r, f, b) for (_, r, b), f in zip(own, faults, strict=True)])))
    return sorted(out, key=repr)


def some_rows(rng, convs, most):
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, most)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.8 else rng.choice([*ROLES, None])
            text = rng.choice(["Yes.", "No!", "Well", "", " \t\n", None, "Is it? ", "Ünï 🙂.", f"Turn {turn} of {conv}.", f"{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("parts", [None, 7])
def test_audits_with_cut_conversations(spark, parts):
    rng = random.Random(5)
    rows = some_rows(rng, [None, *range(40)], 12) + some_rows(rng, [99], 400) + [(7, 3, "user", "Hot.")] * 150
    df = spark.createDataFrame(rows, SCHEMA)
    got = cv.audits_of_all(df, cv.damaged(df), parts)
    if parts:
        spans = cv.in_order(cv.damaged(df), parts).groupBy("conv_id").agg(F.countDistinct("part").alias("n")).where("n > 1").collect()
        assert {99, 7} & {r.conv_id for r in spans}
    order = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.select(order).collect()), key=repr) == plain_audits(rows)


def test_repaired_rows(spark):
    """The repaired rows themselves, from the audits of conversations that no border cuts."""
    rng = random.Random(6)
    df = spark.createDataFrame(some_rows(rng, range(30), 9), SCHEMA)
    rows = cv.in_order(cv.damaged(df), 1)
    found = cv.audits(cv.damaged(df), 1)
    slices = found.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("start"), F.col("audit").alias("edits"))
    got = {}
    for r in cv.repaired_rows(rows, slices).orderBy("conv_id", "k").collect():
        got.setdefault(r.conv_id, []).append(r)
    for r in found.collect():
        kept = got.get(r.conv_id, [])
        assert PATTERN.fullmatch("".join(x.role[0] for x in kept))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in kept).encode()).hexdigest() == r.repaired_sha256


def test_empty_table_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert queries.op11_conversations(spark, f"{tmp_path}/a").collect() == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None)]
    wide = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], SCHEMA + ", part string, fault string, place int, how int, digest string")
    wide.write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert sorted((tuple(r) for r in queries.op11_conversations(spark, f"{tmp_path}/b").collect()), key=repr) == plain_audits(rows)


def test_against_sql(spark, tiny):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tiny}/conversations.parquet'")
    want = sorted(db.sql(queries.ORACLES["op11_conversations"]).fetchall())
    assert sorted(tuple(r) for r in queries.op11_conversations(spark, tiny).collect()) == want

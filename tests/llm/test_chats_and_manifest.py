"""Turn repair, chat formatting and the Merkle manifest against plain versions; queries over odd tables against SQL."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formweave.llm import chat_format, merkle, plans, turn_repair

CHATS = "conv_id long, turn long, role string, text string, step long, kept string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cheapest(symbols):
    """(cost, audit) by Dijkstra over all edits, least audits first."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(symbols) and state in (0, 3):
            return cost, audit
        onward = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, audit + "I", i, onward))
        if i == len(symbols):
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
        if symbols[i] == turn_repair.MUST_GO:
            continue
        initial, cut = divmod(symbols[i] - 2, 2)
        kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, "sua?"[initial]))
        if kept:
            heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, kept))
        heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, onward))


@pytest.fixture(scope="module")
def blocks():
    return turn_repair.Blocks()


@given(st.lists(st.integers(1, 9), max_size=14))
@settings(max_examples=500, deadline=None)
def test_block_tables_find_the_cheapest_repair(blocks, symbols):
    vector, cost, _ = blocks.backward(symbols, 0)
    edits, state = blocks.forward(symbols, 0, 0)
    audit = "".join(edits) + "I" * (turn_repair.AT_END[state] // turn_repair.INSERT)
    assert (cost + blocks.vectors[vector][0], audit) == cheapest(symbols)
    assert len(edits) == len(symbols)


def odd_chats():
    rng = random.Random(5)
    texts = ["Yes.", "No", "", " \t", "Why?", " ", "ok\x0b.", "<|im_end|>", "<\\|x|>", "%0A", None, "é" * 50, "One. Two! Three"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u", "a\nb", "<|im_start|>"]
    rows = []
    for c in [*range(120), None]:
        for t in range(rng.randint(1, 14)):
            turn = rng.choice([t, t, t, None, 0, 3 * t])
            rows.append((c, turn, rng.choice(roles[:2] * 6 + roles), rng.choice(texts), 7, "k", "f"))
    rows += [(500, t, ("user", "assistant")[t % 2], "Again.", 1, "", "") for t in range(4500)]
    rows += [(501, 1, "user", "x" * 300_000 + ".", 1, "", ""), (501, 1, "user", "x" * 300_000 + ".", 1, "", "")]
    # conversations of which every row is dropped
    rows += [(c, 0, "user", "Hi.", 1, "", "") for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rng.shuffle(rows)
    return rows


def odd_documents():
    rng = random.Random(6)
    rows = [(d, rng.choice(["Some Text", "", None, "é" * 9, "low"]) and f"T{rng.random()}", rng.choice(["en", "en", "de", None, "", "é"]), rng.choice(["s", None]),
             rng.choice([1, None]), "h", 1) for d in range(700)]
    rows += [(3, "twice", "en", "s", 5, "h", 1)] * 3 + [(None, "no id", "en", None, 5, "h", 1), (900, "ALONE", "only", "s", 5, "h", 1)]
    rows += [(901, "X" * 200_000, "de", "s", None, "h", 1), (902, None, None, None, None, "h", 1), (-4, "Minus", "de", "s", 2, "h", 1)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_chats(), CHATS).repartition(5).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, source string, n_chars long, hash string, pos int").write.parquet(
        f"{folder}/documents.parquet"
    )
    return folder


def by_sql(name, folder, glob=""):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{glob}'")
    found = con.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)


def by_spark(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op12_chat_format", "op13_merkle"])
def test_queries_over_odd_tables(spark, odd, name):
    assert by_spark(plans.QUERIES[name](spark, odd)) == by_sql(name, odd, "/*.parquet")


def test_repair_over_odd_tables(spark, odd):
    # the SQL twin carries whole audits from row to row, so the long conversation is left to the next test
    got = {r["conv_id"]: r for r in plans.op11_turn_repair(spark, odd).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{odd}/conversations.parquet/*.parquet' WHERE conv_id IS DISTINCT FROM 500")
    found = con.execute(plans.ORACLES["op11_turn_repair"])
    names = [c[0] for c in found.description]
    want = {r[names.index("conv_id")]: r for r in found.fetchall()}
    assert set(got) == set(want) | {500}
    for c, row in want.items():
        assert tuple(got[c][n] for n in names) == row
    assert any(r["audit"] == "" and r["repaired_sha256"] == sha("") for r in got.values())


def plain_audit(rows):
    """(faults, least cost, symbols) of one conversation's rows (turn, role, text), by a table of all its suffixes."""
    blank, seen, symbols, faults = " \t\n\x0b\x0c\r", set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        initial = "sua".find(role[:1]) if role else 3
        initial = 3 if initial < 0 else initial
        fault = "blank" if not text.strip(blank) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(blank)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        symbols.append(turn_repair.MUST_GO if fault in ("blank", "duplicate") else 2 + 2 * initial + (fault == "truncated"))
    costs = [(0, 6, 3, 0)]
    for s in reversed(symbols):
        costs.append(turn_repair.before(costs[-1], s)[0])
    return faults, costs[-1][0], symbols


def test_long_conversation_over_several_chunks(spark, odd):
    rows = [r for r in odd_chats() if r[0] == 500]
    damaged = []
    for _, turn, role, text, *_ in sorted(rows, key=lambda r: r[1]):
        drawn = zlib.crc32(f"500:{turn}".encode()) % 20
        if drawn == 0:
            continue
        text = {1: "", 2: text.replace(".", "")}.get(drawn, text)
        damaged += [(turn, "user" if drawn == 4 else role, text)] * (2 if drawn == 3 else 1)
    faults, cost, _ = plain_audit(damaged)
    got = plans.op11_turn_repair(spark, odd).filter("conv_id = 500").first()
    assert {k: got[k] for k in faults} == faults and got["cost"] == cost
    assert sum(c != "I" for c in got["audit"]) == len(damaged)


def test_long_conversation_of_many_kinds(spark):
    """More rows than a chunk, all symbols: the audit costs what the table of all prefixes says, and gives a right conversation."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice([f"{t}.", f"{t}", "", "again!"])) for t in range(9500)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits = sorted(turn_repair.repair(chats).collect(), key=lambda r: r["step"])
    _, cost, _ = plain_audit([r[1:] for r in rows])
    assert sum(r["cost"] for r in edits) == cost
    initials = "".join(r["role"][0] for r in edits if r["edit"] != "D").removeprefix("s")
    assert initials == "ua" * (len(initials) // 2)
    assert [r["turn"] for r in edits if r["edit"] != "I"] == list(range(9500))
    assert all(r["text"] == "" for r in edits if r["edit"] == "I")


# --- formatting -------------------------------------------------------------

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb%0A"]), st.text("<|>\\im_endstar \n%", max_size=20)), max_size=6)


@given(TURNS)
@settings(max_examples=300, deadline=None)
def test_marked_texts_read_back(turns):
    text, spans, rewritten = chat_format.render(turns, chat_format.marked)
    assert rewritten is None and chat_format.turns_of(text) == turns
    assert [text[a:b] for _, a, b, *_ in spans] == [chat_format.marked([t]) for t in turns]
    learnt = [chat_format.unescape(text[a:b]) for *_, a, b, loss in spans if loss]
    assert learnt == [t for role, t in turns if role == "assistant"]


def test_templates_that_rewrite_history_are_found():
    last_only = lambda turns: "".join(f"[{r}]{t}" if i == len(turns) - 1 else f"[{r}]" for i, (r, t) in enumerate(turns))
    text, spans, rewritten = chat_format.render([("user", "a"), ("assistant", "b"), ("user", "c")], last_only)
    assert (text, spans, rewritten) == ("[user][assistant][user]c", [], 1)
    headed = lambda turns: f"{len(turns)} turns\n" + chat_format.marked(turns)
    assert chat_format.render([("user", "a")], headed)[2] == 0


def test_frames_of_templates_that_trim():
    trimmed = lambda turns: "".join(f"<{r}> {t.strip()} </{r}>" for r, t in turns)
    text, spans, _ = chat_format.render([("user", " q "), ("assistant", "  yes \n")], trimmed)
    assert [text[a:b] for *_, a, b, loss in spans if loss] == ["yes"]


def test_rewriting_template_in_spark(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")]
    last_only = lambda turns: "".join(f"[{r}]{t}" if i == len(turns) - 1 else f"[{r}]" for i, (r, t) in enumerate(turns))
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["rewritten_at"], len(r["spans"])) for r in chat_format.format_chats(chats, last_only).collect()}
    assert got == {1: (1, 0), 2: (None, 1)}


# --- manifest ---------------------------------------------------------------

def plain_manifest(rows):
    """{(doc_id, leaf): (subroot, root, siblings)} of rows (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, (r[0], r[3], r[2], r[4], r[1]))))

    def grow(nodes):
        """(root, siblings of each node)"""
        near, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = p // 8 * 8
                near[i] += [n for j, n in enumerate(nodes[run : run + 8], run) if j != p]
            at = [p // 8 for p in at]
            nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], near

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    grown = {g: grow([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = grow([grown[g][0] for g in order])
    out = {}
    for g, up in zip(order, above, strict=True):
        for (known, d, h), near in zip(sorted(groups[g]), grown[g][1], strict=True):
            out.setdefault((d if known else None, h), []).append((grown[g][0], root, sha("".join(near + up))))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_proofs_match_a_plain_tree(spark, odd, stride):
    rows = [r[:5] for r in odd_documents()]
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = {}
    for r in merkle.proofs(merkle.build(docs, stride=stride)).withColumn("proof", F.sha2(merkle.proof_text(F.col("path")), 256)).collect():
        got.setdefault((r["doc_id"], r["leaf"]), []).append((r["subroot"], r["root"], r["proof"]))
    assert {k: sorted(v) for k, v in got.items()} == plain_manifest(rows)


def test_only_checkpoint_levels_are_stored(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    manifest = merkle.build(docs)
    assert [n.count() for n in manifest.groups.levels] == [5000, 10, 1]
    proofs = merkle.proofs(manifest)
    assert proofs.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 5000
    assert proofs.filter(merkle.folded(F.sha2(F.col("leaf"), 256), F.col("path")) == F.col("root")).count() == 0


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_chat_format", "op13_merkle"])
def test_empty_tables(spark, tmp_path, name):
    folder = str(tmp_path)
    spark.createDataFrame([], CHATS).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    got = plans.QUERIES[name](spark, folder).collect()
    assert [r["conv_id"] for r in got] == ([-1] if name == "op12_chat_format" else [])

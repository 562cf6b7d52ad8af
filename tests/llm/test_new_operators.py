"""Conversation repair, fill-in-the-middle and sharding against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from sparquill.llm import conversations, fill_middle, pii, sharding, tokens

TURNS = "conv_id long, turn long, role string, text string, audit string, code int, pack long"
DOCS = "doc_id long, text string, lang string, shard string, slot int, n int, output string"


def brute_repair(rows):
    """Faults by the rules, then the least (cost, audit) by trying each edit in each state, longest suffix last."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    lawful = re.compile("(s?(ua)+)?")
    # initials so far matter only by what may still follow
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", [])}
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for state, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = after[state].get(role[0])
                    if to:
                        new = (cost + 3, audit + "I", [*out, f"{role}:"])
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        if i == len(rows):
            break
        (_, role, text), fault, following = rows[i], faults[i], {}
        for state, (cost, audit, out) in best.items():
            ways = [(state, cost + 4, "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(after[state][role[:1]], cost + more, "K", [*out, f"{role}:{text}"])] if role[:1] in after[state] else []
                ways += [(after[state][r[0]], cost + 3 + more, "R", [*out, f"{r}:{text}"]) for r in ("user", "assistant") if r[0] in after[state]]
            for to, c, letter, o in ways:
                new = (c, audit + letter, o)
                if to not in following or new[:2] < following[to][:2]:
                    following[to] = new
        best = following
    cost, audit, out = min(v for k, v in best.items() if k in ("", "a"))
    assert lawful.fullmatch("".join(x[0] for x in out))
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def turns():
    rng = random.Random(4)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "", None, "unknown", "anyone"]
    texts = ["Yes.", "No!", "Why?", "Well", "", None, " \t\n\x0b", "Look: 5.0", "Ünïcode… ok.  ", "two\nlines.", " ", ".", "x" * 200_000 + "."]
    rows = []
    for conv in [None, *range(60), -1]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 21])):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.randrange(90)}{rng.choice('.!? ,')}"
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 7]), rng.choice(roles), text, "x", 1, 2))
    rows += [(900, i, ("user", "assistant")[i % 2], f"Turn {i}.", None, None, None) for i in range(700)]
    rows += [(901, 5, "user", "Same.", None, None, None)] * 800  # repeated rows, more than join_sizes leaves to a shuffle
    rows += [(902, i, "user", "Same.", None, None, None) for i in range(800)] + [(903, -(1 << 63), "user", "a.", None, None, None), (903, (1 << 63) - 1, "assistant", "b.", None, None, None)]
    lone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, *rows[:9], (lone, 0, "user", "Gone.", None, None, None)]


def test_conversations(spark):
    table = spark.createDataFrame(turns(), TURNS).repartition(5)
    got = conversations.repair(conversations.damage(table)).collect()
    damaged = brute_damage(turns())
    want = {c: brute_repair(r) if r else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, r in damaged.items()}
    want[903] = ((1 << 63) - 1, *want[903][1:])  # (1 << 64) - 2 turns are missing, more than a long holds
    assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want
    assert conversations.repair(conversations.damage(table.limit(0))).count() == 0
    plain = conversations.repair(table.where("conv_id = 900")).first()
    assert (plain.cost, plain.audit) == (0, "K" * 700)


def test_edits_equal_brute_force_on_all_short_conversations():
    roles, faults = {0: "tool", 1: "system", 2: "user", 3: "assistant"}, {0: "Said {}.", conversations.FAULT_DELETE: " ", conversations.FAULT_TRUNCATED: "said {}"}
    cases = [c for n in range(5) for c in itertools.product([r + f for r in (0, 1, 2, 3) for f in faults], repeat=n)]
    cases = [c for c in cases if len(c) < 4] + random.Random(2).sample([c for c in cases if len(c) == 4], 2000)
    lengths = np.array([len(c) for c in cases])
    flat = np.array([x for c in cases for x in c], np.int64)
    edits, finals, costs = conversations.cheapest_edits(flat, lengths)
    at = 0
    for case, final, cost in zip(cases, finals, costs):
        audit = "".join(conversations._MEANING[e][0] for e in edits[at : at + len(case)]) + "I" * conversations.TAIL[final]
        at += len(case)
        rows = [(i, roles[x & 3], faults[x & ~3].format(i) if x & ~3 != conversations.FAULT_DELETE else " " * (i + 1)) for i, x in enumerate(case)]
        assert brute_repair(rows)[5:7] == (cost, audit), case


def brute_fill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, len(units), form, *sizes, out, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def documents():
    rng = random.Random(8)
    texts = ["", None, "one", "a<P>b", "<M>", "<", "<S", "P>", "><P<S<M", "\x00 nul \x00", "é😀 naïve\r\n\tﬁ", "x" * 50_000, "word " * 40_000, " \n" * 30_000, "'quoted' \\ \"text\""]
    texts += ["".join(rng.choice("ab <>PSM\n.é😀") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i * 7 - 50, t, "en", "s", 1, 2, "o") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]


def test_fill_in_middle(spark):
    docs = spark.createDataFrame(documents(), DOCS).repartition(3)
    want = collections.Counter(brute_fill(r[0], r[1]) for r in documents())
    for size in (fill_middle.BATCH_BYTES, 1000):
        assert collections.Counter(map(tuple, fill_middle.fill_in_middle(docs, batch_bytes=size).collect())) == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"} and all(x[-1] for x in want)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0 and fill_middle.fill_in_middle(docs, text=False).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    other = fill_middle.fill_in_middle(docs, markers=("'p'", "[S]", "{m}"), plain_from=100, spm_below=0).where("form = 'psm'").first()
    assert other.output.startswith("'p'") and "[S]" in other.output and "{m}" in other.output


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 17, 64, 65, 4096, 10_007])
def test_places_are_a_permutation_with_an_inverse(rows):
    n = np.arange(rows)
    p = sharding.place(n, rows, 3)
    assert sorted(p.tolist()) == n.tolist() and sharding.number_at(p, rows, 3).tolist() == n.tolist()
    if rows > 1000:
        assert abs(np.corrcoef(n, p)[0, 1]) < 0.1 and not np.array_equal(p, sharding.place(n, rows, 4))
        assert abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.1


def test_sharding(spark, tmp_path):
    rows = documents() + [(None, "same", None, None, None, None, None)] * 300
    docs = spark.createDataFrame(rows, DOCS)
    got = sharding.assign(docs.repartition(4)).collect()
    text = lambda t: (t or "").encode()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(text(r[1])), zlib.crc32(text(r[1]))))
    at = sharding.place(np.arange(len(rows)), len(rows))
    want = collections.Counter((r[0], len(text(r[1])) + 1, zlib.crc32(text(r[1])), "rows", int(p % 16), int(p // 16), None) for r, p in zip(ordered, at))
    assert collections.Counter(map(tuple, got)) == want == collections.Counter(map(tuple, sharding.assign(docs.repartition(2)).collect()))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    last = ordered[sharding.row_at(5, 7, len(rows), 16)]
    assert (5, 7) in {(r.shard, r.slot) for r in got if r.doc_id == last[0]}
    assert sharding.assign(docs.limit(0)).count() == 0
    # all columns are kept, one's own shard and slot give way
    whole = sharding.shuffled(docs, 3, seed=9)
    assert whole.columns == ["doc_id", "text", "lang", "n", "output", "shard", "slot"] and collections.Counter(r.text for r in whole.collect()) == collections.Counter(r[1] for r in rows)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3, seed=9, rows_a_file=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.slot, r.shard, r.doc_id or 0) for r in back.collect()) == sorted((r.slot, r.shard, r.doc_id or 0) for r in whole.collect())


@pytest.mark.parametrize("name", ["op11_conversations", "op12_fill_middle", "op13_sharding"])
def test_queries_equal_their_twins(spark, name):
    import duckdb

    from sparquill.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, folder), con.execute(queries.ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall())


def test_long_texts_with_special_strings(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BLOCK", 64)
    library, rng = Tokenizer.from_file(tokens.default_tokenizer()), random.Random(6)
    enc = tokens.Encoder(tokens.default_tokenizer())
    for text in ["<|endoftext|>" * 60, "a" * 300 + "<|endoftext|>" * 30, *("".join(rng.choice(["word ", "it's", "<|endoftext|>", "<|end", "|>", "\n\n", "é", "3"]) for _ in range(200)) for _ in range(20))]:
        data = np.frombuffer(text.encode(), np.uint8)
        assert enc.encode_run(data, np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def masked(text):
    return pii.redacted(text, pii.find_spans(text)[1])


def test_no_part_of_a_secret_survives():
    rng = random.Random(1)
    signs = [chr(x) for x in range(33, 127) if chr(x) not in "\"'`"]
    for _ in range(3000):
        value = "".join(rng.choice(signs) for _ in range(rng.randint(8, 40)))
        cue = "".join(rng.choice((c, c.upper())) for c in rng.choice(pii.SECRET_CUES))
        sign = rng.choice([": ", "=", " = ", ":", " := ", " => "])
        ahead, behind = rng.choice(["", "the ", "x; "]), rng.choice(["", " and on", "\nnext"])
        # a secret that looks like an address, too, may bear that name
        assert re.sub(r"\[[A-Z]+\]", "[SECRET]", masked(f"{ahead}{cue}{sign}{value}{behind}")) == f"{ahead}{cue}{sign}[SECRET]{behind}", value
        quote = rng.choice("\"'`")
        spaced = value + " " + value
        if not spaced.endswith("\\"):
            assert re.sub(r"\[[A-Z]+\]", "[SECRET]", masked(f"{ahead}{cue}{sign}{quote}{spaced}{quote}{behind}")) == f"{ahead}{cue}{sign}{quote}[SECRET]{quote}{behind}", spaced
    assert masked('{"password": "correct horse", "b": 1}') == '{"password": "[SECRET]", "b": 1}'
    assert masked("password: correcthorsebattery") == "password: [SECRET]" and masked("İ PassWord: Tr0ub4dor&3xyzzy!") == "İ PassWord: [SECRET]"
    assert masked('secret = "unclosed9&9 and on') == 'secret = "[SECRET] and on' and masked('token="a\\"b\\"c1234" x') == 'token="[SECRET]" x'
    assert masked("a password is needed; the token: short") == "a password is needed; the token: short"


def test_schemes_accounts_and_addresses_whole():
    assert masked("see s3://bucket.example.com/key, git+ssh://host.example.org/x.git.") == "see [URL], [URL]."
    assert masked("a-very.long+scheme2://host/path") == "[URL]" and masked("1http://host.example") == "1[URL]" and masked("c ://x.y") == "c ://x.y"
    assert masked("Pay DE89 3704 0044 0532 0130 00 now") == "Pay [ACCOUNT] now" and masked("XDE89370400440532013000") != "X[ACCOUNT]"
    long = "12345 " + " ".join(["A" + "b" * 28] * 4) + " Street"
    assert masked(f"at {long}, then") == "at [ADDRESS], then" and masked("a street, 12 main street") == "a street, 12 main street"


def test_long_runs_of_cues_take_linear_time():
    import time

    for part in ("password='", 'token="x', "://", "a+", "secret=secret=", "DE8 ", " Street"):
        began = time.perf_counter()
        pii.find_spans(part * 40_000)
        assert time.perf_counter() - began < 5, part

"""Whole queries against plain Python, planted vectors, hot keys, odd tables and clashing columns."""

import base64
import math
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from test_text_ops import ODD, spans

import corpus_pipeline
from geostrata.llm import common, decontam, langid, linededup, minhash, packing, pii, quality, queries, secrets, tokencount, vecdedup

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
BLANKS = b"\t\x0b\x0c\r \n"


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def plain_statistics(text):
    """``quality.FEATURES`` of one text, counted byte by byte."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    w, n, k = max(len(words), 1), len(raw), max(len(lines), 1)
    share = lambda good: sum(map(good, raw)) / n
    symbols, marks = b"!#$%&*|~^_=+<>{}[]\\@/", b".,;:?"
    pairs = list(zip(words, words[1:], strict=False))
    upper = lambda x: sum(65 <= c <= 90 for c in x) > 1 and not any(97 <= c <= 122 for c in x)
    ends = raw.count(b"\n")
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / w,
        share(lambda c: 97 <= c <= 122), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b"\t\x0b\x0c\r "), ends / n, share(lambda c: c in marks), share(lambda c: c in symbols), share(lambda c: c >= 128),
        sum(map(upper, words)) / w, sum(any(c in symbols for c in x) for x in words) / w, sum(len(x) <= 3 for x in words) / w, sum(len(x) > 16 for x in words) / w,
        len(set(words)) / w, max(Counter(words).values(), default=0) / w, sum(a == b for a, b in pairs) / w, len(set(pairs)) / max(len(pairs), 1),
        math.log1p(len(lines)), len(words) / k, 1 - len(set(lines)) / k, max(ends + 1 - len(lines), 0) / (ends + 1), sum(c in marks for c in raw) / w,
    ]


def walked(model, x):
    total = model.base
    for t in range(len(model.feature)):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + 1 + (x[model.feature[t, node]] > model.threshold[t, node])
        total += model.leaf[t, node - (2**model.depth - 1)]
    return 1 / (1 + math.exp(-max(-60, min(60, total))))


def test_quality_scores(spark, docs):
    d, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(d, labels)
    for table, own in ((d, texts_of(spark)), (docs(ODD), dict(enumerate(ODD)))):
        got = {r.doc_id: r.score for r in quality.quality_scores(table, labels).collect()} if table is d else None
        for i, t in own.items():
            x = plain_statistics(t)
            raw = np.frombuffer((t or "").encode(), np.uint8)
            assert quality.statistics(raw, np.array([0, len(raw)]))[0] == pytest.approx(x), t
            if got:
                assert got[i] == pytest.approx(walked(model, np.array(x, np.float32).astype(float)), abs=1e-9)


def test_quality_odd_tables(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert quality.quality_scores(docs(["a"]).limit(0), labels).count() == 0
    long_ = docs(["word " * 400_000, "word " * 400_000, None], ids=[7, 7, None])
    got = quality.quality_scores(long_, labels).collect()
    assert len({r.score for r in got if r.doc_id == 7}) == 1 and len(got) == 3
    same = labels.unionByName(labels.limit(0))
    many = docs(["a b", "c d", "c d"], ids=[0, 0, 0]).unionByName(docs(["x y"] * 4, ids=[1, 3, 4, 5]))
    assert quality.quality_scores(many, same, max_train=2).count() == 7  # repeated ids don't stretch the sample


def test_language_scores(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    m, got = langid.train(d), {r.doc_id: r for r in langid.identify(d).collect()}
    for i, t in texts_of(spark).items():
        raw = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (t or "").encode())
        total, count = np.zeros(len(m.langs)), 0
        for n in (1, 2, 3):
            for gram, c in Counter(raw[a : a + n] for a in range(len(raw) - n + 1)).items():
                if any(x != 32 for x in gram):
                    bucket = ((int.from_bytes(gram, "little") + (n << 24)) * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS)
                    total += c * m.table[bucket]
                    count += c
        z = (total / max(count, 1) + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if any(map(str.isalpha, t or "")):
            assert got[i].lang_pred == m.langs[int(p.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-9)
            assert got[i].rejected == (got[i].score < m.reject_below)
        else:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)


def test_token_counts_query(spark, docs):
    with open(queries.COUNT_VOCABULARY, "rb") as f:
        own = {base64.b64decode(x.split()[0]) for x in f if x.strip()} | {bytes([b]) for b in range(256)}
    longest, known = max(map(len, own)), {}

    def greedy(word):
        if word not in known:
            at = n = 0
            while at < len(word):
                at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in own)
                n += 1
            known[word] = n
        return known[word]

    got = {r.doc_id: r for r in queries.op8_token_counts(spark, DATA).collect()}
    for i, t in texts_of(spark).items():
        counts = [greedy(b" " + w.encode()) for w in (t or "").split()]
        assert (got[i].n_words, got[i].n_tokens, got[i].longest_word_tokens) == (len(counts), sum(counts), max(counts, default=0))
    odd = tokencount.token_counts(docs(["the x", "the x", None], ids=[1, 1, None]), queries.COUNT_VOCABULARY)
    assert sorted((r.doc_id or 0, r.n_words) for r in odd.collect()) == [(0, 0), (1, 2), (1, 2)]
    assert tokencount.token_counts(docs(["a"]).limit(0), queries.COUNT_VOCABULARY).count() == 0


def plain_candidates(text):
    """(start, end) of the runs of key characters that may be secrets."""
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    at = 0
    while at < len(text):
        if text[at] not in key:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] in key:
            end += 1
        run = text[at:end]
        digit = next((i for i, c in enumerate(run) if c.isdigit()), None)
        small = next((i for i, c in enumerate(run) if c.islower()), len(run))
        after = next((i for i in range(small, len(run)) if not run[i].islower()), len(run))
        camel = after < len(run) and after > small and run[after].isupper() and not any(c.isdigit() for c in run[:small]) and after - small <= 200
        if len(run) >= 16 and (digit is not None and digit <= 200 or camel):
            pad = 0
            for k in (2, 1):
                rest = text[end + k : end + k + 2]
                nxt = rest[1:2] if rest[:1] in ("'", '"', "`") and rest[:1] else rest[:1]
                if text[end : end + k] == "=" * k and not (rest and (rest[0] in key | {"="} or rest[0] in "'\"`" and nxt and nxt in key | {"="})):
                    pad = k
                    break
            yield at, end + pad
        at = end


def plain_features(value, before, after, path):
    n, path = len(value), (path or "").lower()
    share = lambda good: sum(map(good, value)) / n
    kind = lambda c: "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else None
    changes = sum(kind(a) is not None and kind(a) != kind(b) for a, b in zip(value, value[1:], strict=False))
    words, left = "|".join(sorted(secrets.WORDS, key=lambda w: (-len(w), w))), value.lower()
    flag = lambda p, s: float(bool(regex.search(p, s)))
    return [
        min(n, 200), share(str.isdigit), share(str.isupper), share(str.islower), share(lambda c: kind(c) is None), share(lambda c: c in "0123456789abcdefABCDEF"),
        flag("^[0-9a-f]+$|^[0-9A-F]+$", value), flag("^[0-9]+$", value), len(set(value)) / min(n, 64), changes / n, share(lambda c: c in "aeiouAEIOU"),
        1 - len(regex.sub(words, "", left)) / n, flag(r"[=:]\s*[\"']?$", before), float(bool(regex.search(r"[\"'`]$", before)) and bool(regex.search(r"^[\"'`]", after))), flag(secrets.KEYWORDS + r"[\w\"' ]{0,12}[=:]?\s*[\"']?$", before), flag(secrets.LOOKALIKES + r"\W{0,6}$", before),
        flag("^(AKIA|ASIA)[0-9A-Z]{16}$|^(ghp|gho|xoxb|sk|pk|rk)[_-]|^eyJ|^glpat-", value), flag("test|spec|mock|fixture|sample|example", path), flag(r"\.(py|js|ts|go|java|rb|sh|env|ya?ml|json|ini|cfg|toml)$", path),
    ]


def test_secrets_query(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    r = random.Random(6)
    extra = ["".join(r.choice(["password=", 'token = "', "Aa1", "b7db7aa4a5fcc783", "==", "=", '"', " ", "é", "/", "abcDEF", "_", "commit ", "XYZ"]) for _ in range(14)) for _ in range(120)]
    more = d.limit(0).unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    model = secrets.train(secrets.labelled_findings(spark))
    found = d.unionByName(more)
    got = {x.doc_id: x for x in secrets.secret_report(found, model).collect()}
    n = 0
    for row in found.select("doc_id", "text", "source").collect():
        text = row.text or ""
        cand = list(plain_candidates(text))
        assert got[row.doc_id].n_candidates == len(cand), text
        own = []
        for a, b in cand:
            x = plain_features(text[a:b], text[max(0, a - secrets.CONTEXT) : a], text[b : b + secrets.CONTEXT], row.source)
            if round(model.predictProbability(Vectors.dense(x))[1], 6) >= secrets.THRESHOLD:
                own.append(f"{a}:{b}")
        n += len(own)
        assert got[row.doc_id].spans == ",".join(own), text
    assert n > 0


def test_secrets_held_out(spark):
    """Precision and recall on findings that the forest wasn't trained on."""
    every = secrets.labelled_findings(spark, 3 * secrets.FINDINGS).withColumn("k", F.monotonically_increasing_id())
    model = secrets.train(every.where(f"k < {secrets.FINDINGS}"))
    rest = every.where(f"k >= {secrets.FINDINGS}").collect()
    yes = [model.predictProbability(Vectors.dense(plain_features(r.value, r.before[-secrets.CONTEXT :], r.after, r.path)))[1] >= secrets.THRESHOLD for r in rest]
    right = sum(y and r.label for y, r in zip(yes, rest, strict=True))
    assert right / sum(yes) >= 0.97 and right / sum(r.label for r in rest) >= 0.97


def test_secrets_odd_rows(docs):
    t = 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ' + "word " * 200_000
    got = secrets.secret_report(docs([t, t, None], ids=[3, 3, None])).collect()
    assert sorted((x.doc_id or 0, x.n_secrets) for x in got) == [(0, 0), (3, 1), (3, 1)]


def plain_terms(rows, support=pii.SUPPORT, disclose=pii.DISCLOSE):
    """Spans of disclosing terms by row, from document frequencies."""
    near, both, entity_docs, term_docs = [], {}, {}, Counter()
    for i, text in rows.items():
        t = text or ""
        term_docs.update(set(regex.findall(r"\p{L}{3,}", t.lower())))
        for s in filter(None, spans(t).split(",")):
            kind, a, b = s.split(":")
            a, b = int(a), int(b)
            value = t[a:b]
            name = f"{kind}:{''.join(c for c in value if c in '0123456789') if kind in ('card', 'phone') else value.lower()}"
            words = [m for m in regex.finditer(r"\p{L}{3,}", t[:a]) if m.start() >= a - pii.CONTEXT]
            own = [(m.start(), m.end(), m.group().lower()) for m in words]
            own += [(b + m.start(), b + m.end(), m.group().lower()) for m in regex.finditer(r"\p{L}{3,}", t[b:]) if m.end() < pii.CONTEXT + 1]
            near += [(i, name, *w) for w in own]
    for i, name, _, _, term in near:
        both.setdefault((name, term), set()).add(i)
        entity_docs.setdefault(name, set()).add(i)
    n, good = len(rows), set()
    for (name, term), where in both.items():
        if min(len(where), len(entity_docs[name]), term_docs[term]) >= support:
            bits = math.log2(n / len(entity_docs[name]))
            if bits > 0 and math.log2(n * len(where) / (term_docs[term] * len(entity_docs[name]))) / bits >= disclose:
                good.add((name, term))
    out = {i: set() for i in rows}
    for i, name, a, b, term in near:
        if (name, term) in good:
            out[i].add((a, b))
    return out


def test_pii_terms_query(spark, docs):
    r = random.Random(8)
    words = ["kestrel", "harbour", "ab", "été", "lantern", "quill", "ember", "moss", "tundra", "x"]
    names = [(f"p{k}@mail.org", f"nick{k}") for k in range(6)] + [("10.0.0.7", "router"), ("4111 1111 1111 1111", "visa"), ("+1 555 123 4567", "desk")]
    rows = {}
    for i in range(160):
        e, tell = r.choice(names)
        near = [tell if r.random() < 0.8 and c.isalpha() is False else c for c in (r.choice(words) for _ in range(r.randint(0, 14)))]
        rows[i] = " ".join([*near, *([tell] if r.random() < 0.7 else []), e, *(r.choice(words) for _ in range(r.randint(0, 30))), *([r.choice(names)[0], tell + "."] if r.random() < 0.3 else [])])
    ties = {**rows, 160: rows[0], 161: None, 162: ""}
    want = plain_terms(ties)
    got = {x.doc_id: x for x in pii.pii_report(docs(list(ties.values()), ids=list(ties))).collect()}
    for i in ties:
        terms = [s for s in got[i].spans.split(",") if s.startswith("term:")]
        assert terms == [f"term:{a}:{b}" for a, b in sorted(want[i])], ties[i]
    assert any(want.values())
    own = texts_of(spark)
    want, got = plain_terms(own), {x.doc_id: x for x in queries.op4_pii(spark, DATA).collect()}
    assert {i: got[i].n_term for i in own} == {i: len(x) for i, x in want.items()}


def test_planted_vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u, w = x[:2500], rng.standard_normal((2500, 64))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = rng.uniform(0.88, 0.93, (2500, 1))
    v = np.concatenate([x, c * u + np.sqrt(1 - c * c) * w, x[:1] + 0.03 * rng.standard_normal((300, 64)), x[5:6].repeat(40, 0)])
    d = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    for block in (vecdedup.BLOCK, 100):
        got = {r.vec_id: r for r in vecdedup.near_vectors(d, block=block).collect()}
        links = np.array([got[i].n_links for i in range(len(v))])
        planted = slice(4000, 6500)
        assert (links <= near.sum(1)).all() and links[planted].sum() >= 0.985 * near[planted].sum()
        assert links[6500:].sum() >= 0.999 * near[6500:].sum()
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.n_links for r in vecdedup.near_vectors(vecs).orderBy("vec_id").collect()] == [1, 1, 0]


def test_vector_plan():
    for n in (10, 10_000, 10**6, 10**9):
        directions, tail = vecdedup.layout(n)
        count, p = vecdedup.calibrate(0.9, directions, tail)
        assert count >= 1 and p >= 0.99 and 2 * directions * tail == pytest.approx(vecdedup.ROWS, rel=0.01)


def test_hot_keys(docs, monkeypatch):
    """Keys beyond the bound are broadcast; results stay the same."""
    t = [" ".join(f"w{k}{i}" for i in range(60)) for k in range(3)]
    texts = [t[0], t[1], "\n".join(t), None, ""] + [t[0]] * 9 + [f"{t[0]}\n{t[1]} x"] * 4 + [t[2] + f" {i}" for i in range(5)]
    runs = lambda: [sorted(map(str, f(docs(texts)).collect())) for f in (minhash.near_duplicates, linededup.line_report)]
    want = runs()
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(minhash, "PART_SHINGLES", 100)
    assert runs() == want


CLASHING = ["_cuts", "_id", "_h", "_marks", "_items", "_lines", "_of", "_gone", "n", "part", "m", "i", "rep", "component"]


def test_clashing_columns_and_odd_rows(spark, docs):
    texts = ["mail a@b.org now", 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', *ODD, "one two three four five six seven eight nine ten", "one two"]
    d = docs(texts, ids=[None, 1, 1, *range(4, len(texts) + 1)])
    for c in CLASHING:
        d = d.withColumn(c, F.lit("kept"))
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "zz yy")], "item_id long, text string")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    own = {
        "sanitise": pii.sanitise, "redact": secrets.redact, "lines": linededup.dedup_lines, "near": minhash.keep_one,
        "bench": lambda x: decontam.decontaminate(x, bench, max_share=1.0), "blocks": lambda x: decontam.decontaminate(x, bench, max_share=1.0, block_chars=60),
        "quality": lambda x: quality.keep_quality(x, labels, threshold=0.0),
    }
    for name, f in own.items():
        got = f(d)
        assert got.columns == d.columns, name
        rows = got.collect()
        assert rows and all(r[c] == "kept" for r in rows for c in CLASHING) and f(d.limit(0)).count() == 0, name
        if name not in ("near", "lines"):
            assert len(rows) == len(texts), name
    assert pii.sanitise(d).where("doc_id is null").first().text == "mail [EMAIL] now"


def test_pipeline_odd_tables(spark, docs):
    d = docs(["good words of a text " * 30, *ODD], ids=[None, 1, 1, *range(3, 3 + len(ODD) - 2)]).withColumn("_cuts", F.lit(1)).withColumn("_marks", F.lit("x"))
    for table in (d, d.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, DATA)
            assert out.columns == d.columns and out.count() <= table.count(), name
        pieces = corpus_pipeline.STAGES[-1][1](spark, table, DATA)
        assert pieces.where("start = 0").count() == table.count()


def test_packing_odd_rows(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs(["a b c", "a b c", None, ""], ids=[1, 1, None, 2]), path).collect()
    assert sum(p.length for p in got if p.doc_id == 1) == 2 * next(p.doc_tokens for p in got if p.doc_id == 1)
    assert [(p.length, p.doc_tokens) for p in got if p.doc_id != 1] == [(1, 1), (1, 1)]
    assert packing.pack(docs(["a"]).limit(0), path).count() == 0

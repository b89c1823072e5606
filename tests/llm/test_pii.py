import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii, queries


def plain_base(text):
    """The contract's patterns as they are written."""
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split(".")) or kind == 2 and 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0 or kind == 3 and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = ["", "a@b", "a@b.c", "x.a@b.c.d-@e.f", "a@b.com_x@y.com", "a@b.c@d.e", "@b.c", "a@@b.c", "é@b.c é", "1.2.3.4.5.6.7.8", "1.2.3.256 10.0.0.1", "0001.002.3.4", "4111 1111 1111 1111", "4111-1111 1111-1112", "41111111111111114111111111111111", "4 1 1 1  1111111111111", "+1 (377) 555-0271", "+1 2", "+123456789012345678", "+1(((((((((", "+1-+49 30 1234567.", "12  4222222222222", "9" * 4000 + ".1.1.1"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a@b.-_+1 47()é%\n0"), max_size=60))
def test_base_equals_the_patterns_on_any_text(text):
    assert pii.base_spans(text) == plain_base(text)


def test_long_runs_are_no_trouble():
    for text in ("a" * 1_000_000, "9" * 1_000_000, "1." * 500_000, "+1" + " (" * 500_000, "1 " * 500_000, "a@" * 300_000, "a." * 300_000 + "@b.c"):
        pii.base_spans(text)


def plain_terms(texts, reach=8, alpha=0.8, witnesses=3):
    """The docstring's rule by dictionaries: disclosing terms and what replaces them."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    find = lambda t: list(re.finditer(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low(t)))
    total, near = Counter(), {False: defaultdict(Counter), True: defaultdict(Counter)}
    for text in texts:
        spans = plain_base(text)
        for m in find(text):
            total[False, m.group()] += 1
            total[True, pii.general(m.group())] += 1
        terms = [m for m in find(text) if not any(m.start() < e and s < m.end() for _, s, e in spans)]
        seen = set()
        for k, s, e in spans:
            name = pii.entity(k, text[s:e])
            before, after = [i for i, m in enumerate(terms) if m.end() <= s][-reach:], [i for i, m in enumerate(terms) if m.start() >= e][:reach]
            for i in before + after:
                if (name, i) not in seen:
                    seen.add((name, i))
                    for beside in ((0, terms[i - 1].group() if i else ""), (1, terms[i + 1].group() if i + 1 < len(terms) else "")):
                        near[False][name, terms[i].group()][beside] += 1
                        near[True][name, pii.general(terms[i].group())][beside] += 1
    everything = sum(n for (wide, _), n in total.items() if not wide)
    around = Counter()
    for (name, _), c in near[False].items():
        around[name] += sum(c.values()) // 2

    def tells(wide, name, key):
        c = near[wide][name, key]
        n = sum(c.values()) // 2
        known = math.log2(everything / around[name])
        return all(n * n >= witnesses * sum(x * x for (k, _), x in c.items() if k == side) for side in (0, 1)) and known > 0 and math.log2(n / total[wide, key] / (around[name] / everything)) >= alpha * known

    out = {}
    for name, term in list(near[False]):
        if tells(False, name, term):
            wide = tells(True, name, pii.general(term))
            out[term] = pii.REMOVED if wide or out.get(term) == pii.REMOVED else pii.general(term)
    return out


def corpus():
    """A name and a room stand with one address in ten different sentences; a copied passage stands with another."""
    fill = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    rows = [(i, f"{fill[i]} {fill[i + 1]} Zebulonius {fill[i + 2]} room4711 {fill[(3 * i) % 24]} writes to zeb@corp.example.com {fill[(5 * i) % 24]} today") for i in range(10)]
    rows += [(10 + i, f"{fill[i % 24]} the unique copied passage with marvellous words near copy@corp.example.com and more after it") for i in range(60)]
    rows += [(100 + i, " ".join(fill[(i * k) % 24] for k in range(1, 40)) + f" room{1000 + i} zebulon zebra") for i in range(60)]
    return [*rows, (200, "Here Zebulonius stands alone."), (201, None), (202, ""), (None, "zeb@corp.example.com"), (200, "Here Zebulonius stands alone."), (203, "é " * 30_000 + "ZEBULONIUS")]


KIND = "doc_id bigint, text string"


def test_disclosing_terms_are_found_everywhere_and_copies_are_no_evidence(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, KIND)
    got = {r.term: r.replacement for r in pii.disclosing_terms(df).collect()}
    assert got == plain_terms([t or "" for _, t in rows])
    assert got["zebulonius"] == "zebul*" or got["zebulonius"] == pii.REMOVED
    assert got["room4711"] == "room####"
    assert not {"marvellous", "unique", "today", "alpha"} & got.keys()
    found = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in pii.pii_findings(df).collect()}
    assert (200, (("term", 5, 15),)) in found and (203, (("term", 60_000, 60_010),)) in found and (None, (("email", 0, 20),)) in found
    assert {i for i, s in found if not s} >= {201, 202, 100, 130}
    assert pii.pii_findings(df).count() == len(rows)


def test_sanitised_documents_keep_rows_and_columns(spark):
    rows = [(i, t, len(t) if t is not None else None, 1) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, `_key` int")
    out = pii.sanitised_documents(df)
    assert out.columns == df.columns
    got = sorted(out.collect(), key=str)
    assert len(got) == len(rows)
    assert not any(r.text and re.search("zebulonius|room4711|@corp", r.text, re.I) for r in got)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)
    assert {r.text for r in got if r.doc_id == 201} == {None}
    kept = {r.doc_id: r.text for r in got}
    assert kept[130] == dict(corpus())[130]


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert pii.pii_findings(none).count() == pii.sanitised_documents(none).count() == 0
    one = spark.createDataFrame([(1, "call +1 (377) 555-0271 now")], KIND)
    assert [tuple(s) for s in pii.pii_findings(one).first().spans] == [(5, "phone", 22, "[PHONE]")]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_query_equals_a_plain_version(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    terms = plain_terms([r.text or "" for r in rows])
    want = {}
    for r in rows:
        text = r.text or ""
        base = plain_base(text)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        more = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low) if m.group() in terms and not any(m.start() < e and s < m.end() for _, s, e in base)]
        want[r.doc_id] = (*[sum(k == i for k, _, _ in base) for i in range(4)], ",".join([f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base] + [f"term:{s}:{e}" for s, e in more]))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in queries.op11_pii(spark, d).collect()}
    assert got == want

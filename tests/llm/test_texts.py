import random

import numpy as np
import pytest

from tidemark.llm import packing, residue, token_ids

DOCS = "doc_id long, text string, source string, ids string, kind string"
EDGE = [None, "", "   ", "<|endoftext|>", "a" * 40_000, "日本。" * 9000, "x y\n" * 9000, " " * 20_000, "don't we'll " * 3000, "é́​\U0001f30a" * 4000]


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "clash", "clash") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("piece", [16_384, 997])
def test_ids_are_those_of_the_whole_text(spark, piece):
    encoding, _ = token_ids.tokenizer("byte_bpe_50k")
    got = {r.doc_id: list(r.ids) for r in token_ids.encode(documents(spark, EDGE), piece=piece).collect()}
    assert got == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(EDGE)}
    assert token_ids.encode(documents(spark, EDGE).limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    encoding, _ = token_ids.tokenizer("byte_bpe_50k")
    long, other = "word and more " * 2000, "another 12 text " * 2000
    rows = [(1, long), (1, long), (1, other), (None, long), (None, other), (None, other), (2**60 + 1, long), (2**60 + 1, "short"), (3, "short"), (3, "short"), (None, "short"), (None, None)]
    df = spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in rows], DOCS)

    def order(found):
        return sorted(found, key=lambda r: (r[0] or 0, r[1]))

    want = order((i, encoding.encode_ordinary(t or "")) for i, t in rows)
    assert order((r.doc_id, list(r.ids)) for r in token_ids.encode(df).collect()) == want
    kinds = spark.createDataFrame([("big", 100_000), ("small", 1000)], "container string, capacity_tokens int")
    out = packing.pack(df, kinds).collect()
    for kind in ("big", "small"):
        mine = [r for r in out if r.container == kind]
        for i in {i for i, _ in rows}:
            assert sum(r.tokens for r in mine if r.doc_id == i) == sum(len(ids) for j, ids in want if j == i)
    assert order((r.doc_id, r.tokens) for r in out if r.container == "big") == order((i, len(ids)) for i, ids in want)


def test_agrees_with_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{token_ids.FOLDER}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    encoding, _ = token_ids.tokenizer("byte_bpe_50k")
    for t in [x for x in EDGE if x]:
        assert encoding.encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids


def test_joins_at_any_place():
    encoding, lengths = token_ids.tokenizer("byte_bpe_50k")
    rng = random.Random(7)
    letters = ["a", "ing", " the", " ", "\n", "'s", "42", "é", "漢", "。", "​", "!!"]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(2, 400)))
        k = rng.randrange(1, 60)
        parts = [np.asarray(encoding.encode_ordinary(text[i : i + k]), dtype=np.int32) for i in range(0, len(text), k)]
        assert token_ids.concatenate(parts, encoding, lengths).tolist() == encoding.encode_ordinary(text)


def test_packing(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["wind", "sea", "log"]) + str(i) for _ in range(rng.choice([1, 5, 30, 200, 900]))) for i in range(300)]
    texts += ["the same text of some length"] * 40 + [None, "", "  "]
    df = documents(spark, texts)
    kinds = spark.createDataFrame([("small", 64), ("large", 1024)], "container string, capacity_tokens int")
    out = packing.pack(df, kinds, group=150).toPandas()
    size = {r.doc_id: len(r.ids) for r in token_ids.encode(df).collect()}
    for kind, capacity in (("small", 64), ("large", 1024)):
        part = out[out["container"] == kind]
        assert part.groupby("bin")["tokens"].sum().max() <= capacity
        assert part.groupby("doc_id")["tokens"].sum().to_dict() == size
        whole = part.groupby("doc_id").size()
        assert all(n == max(1, -(-size[d] // capacity)) for d, n in whole.items())
        same = part[part["doc_id"].between(300, 339)]
        assert same["bin"].nunique() == 40
    fill = {r.container: r.fill for r in packing.fill_rates(packing.pack(df, kinds), kinds).collect()}
    assert fill["small"] > 0.97
    with pytest.raises(ValueError):
        packing.pack(df, spark.createDataFrame([("bad", None)], "container string, capacity_tokens int"))
    assert packing.pack(df.limit(0), kinds).count() == 0


def test_best_fit_honours_conflicts():
    sizes = np.array([5, 5, 3, 2, 2])
    place = packing.best_fit(sizes, [1, 2, 1, 2, 1], [0, 0, 4, 4, 0], [2, 1, 2, 1, 2], 10)
    bins = {}
    for i, b in enumerate(place):
        bins.setdefault(b, []).append(i)
    for items in bins.values():
        assert len({[1, 2, 1, 2, 1][i] for i in items}) == 1 and sum(sizes[items]) <= 10
    assert place[2] != place[3]


CASES = [
    "Dear {{ observer }}, all is well.", "Log of <enter ship name>,", "at __lat_lon__ was seen", "Objet : [à compléter : name],", "TBD TBD TBD", "Lorem ipsum dolor sit amet, consectetur", "<html><h1>HTTP/1.1 503 Service Unavailable</h1></html>",
    "The count came to 3.\nTraceback (most recent call last):\n  File \"x.py\"", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS LOG.", "Plea​se enable Java​Script to view", "x" * 60_000 + "\nSorry, the chart could not be loaded (timeout).", "Ref. ____ was seen", "ここに文章が入ります。",
]
PLAIN = [
    None, "", "   ", "Our handbook explains that ${NAME} is replaced by the mailing program before sending.", "The pilot wrote two scripts; the second needs to be enabled by a lamp.", "Error 503 of the list of errata concerns the sea bucket.", "Gauge 404 was not found in the store.",
    "Column 7 was filled with crosses, xxx, where no reading was taken.", "The manual warns that 'lorem ipsum' in a column means a proof.", "Mean 5% of 10 and <p>page</p>", "The line ____ was left", "y" * 60_000,
]


def test_residue(spark):
    texts = [*CASES, "Ref. {{ ship }} was seen", *PLAIN]
    got = {r.doc_id for r in residue.found(documents(spark, texts)).collect()}
    assert got == set(range(len(CASES) + 1))
    assert residue.found(documents(spark, texts).limit(0)).count() == 0
    kinds = {r.kind for r in residue.suspicious(documents(spark, texts)).collect()}
    assert {"slot", "filler", "error", "script", "mention", "blank", "induce"} <= kinds


def test_templates_are_induced_by_alignment(spark):
    """Neither sentence is in a list of wordings: one is aligned with a page that is, one is a blank that is filled in elsewhere."""
    texts = ["We cannot find that page. Go back.", "The log ends here. We cannot find that station sheet. Go back.", "We find that sheets cannot last.", "Observer: ____", "Observer: Smith", "Observer: Jones", "Remark: ____", "Officer: ____", "Officer: Smith", "Officer: Smith"]
    assert {r.doc_id for r in residue.found(documents(spark, texts)).collect()} == {0, 1, 3}
    found = {(r.template, r.fillings) for r in residue.templates(documents(spark, texts)).collect()}
    assert ("we cannot find that * .", 2) in found
    # the same with sentences and templates joined
    try:
        residue.TEMPLATES = 3
        assert {r.doc_id for r in residue.found(documents(spark, texts)).collect()} == {0, 1, 3}
    finally:
        residue.TEMPLATES = 500_000


@pytest.mark.parametrize("most", [500_000, 0])
def test_long_sentences_and_short_templates_are_aligned(spark, monkeypatch, most):
    """Sentences of more than 60 words, and blanks with one word on either side; held by a task and joined."""
    monkeypatch.setattr(residue, "TEMPLATES", most)
    log, list_ = (" ".join(f"{c}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)) for c in "kl")
    texts = [
        f"{log} we cannot find that page {log}", f"{log} we cannot find that sheet {log}", f"{log} we cannot find another {log} sheet", f"The {list_} was ____ there {list_}", f"The {list_} was left there {list_}", f"The {list_} was right there {list_}",
        f"The {log} was ____ there", "Date ____.", "Date Monday.", "Date Friday.", "Post ____.", "Post Monday.",
    ]
    assert {r.doc_id for r in residue.found(documents(spark, texts)).collect()} == {0, 1, 3, 7}
    found = {(r.template, r.kind, r.records, r.fillings) for r in residue.templates(documents(spark, texts)).collect()}
    assert (f"{log} we cannot find that * {log}", "error", 2, 2) in found and len(found) == 6 and not any(residue.DIGEST in t for t, *_ in found)


@pytest.mark.parametrize("n", [4, 60, 61, 62, 63, 200])
def test_keys_are_equal_if_templates_are(n):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)]
    for i in (0, 1, n // 2, n - 2):
        other = {k: (a, b) for k, a, b in residue.aligned([*words[:i], "x", "y", *words[i + 1 :]])}
        common = {(k, a, b, *other[k]) for k, a, b in residue.aligned(words) if k in other}
        assert common and all(words[:a] == words[:c] and a == c and b - a + 1 == d - c and a <= i < b for _, a, b, c, d in common)
        assert residue._key(words[:i], words[i + 1 :]) in {k for k, *_ in common}


def test_the_prefilter_loses_no_wording():
    """Whatever a wording may match holds a word that the automaton looks for, folded or not."""
    automaton = residue._automaton()
    more = [
        "Checking your browser before you continue.", "The requested page is gone.", "Turn them on in your browser", "Tràceback (most recent call last):", "ＬＯＲＥＭ ＩＰＳＵＭ ＤＯＬＯＲ", "504 Gateway Time-out", "Access denied", "Page not found",
        "Error establishing a database connection", "[Your Name Here]", "Dear [First Name],", "Java<b>Script</b> is required", "lorem\nipsum\ndolor",
    ]
    for text in [*CASES, *PLAIN, *more]:
        if text is not None:
            assert residue.judge(text, automaton) == residue.judge(text)
    assert all(residue.judge(t, automaton) for t in more if "<b>" not in t)
    assert residue.needed(r"\b(?:ab(?:cd|ef)+x|gh) ij*") == ["ab", "gh"]
    for _, pattern in residue._WORDINGS:
        assert residue.needed(pattern.pattern)

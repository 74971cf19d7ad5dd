"""Template residue, filler and error-page text (problem 10).

Records are cut into sentences, which are aligned across all records: two belong to one template if they are equal but for one span of
up to three words each (numbers and hexadecimal ids count as equal). That span is the template's slot. Sentences may have any length:
templates of more than 60 words are told by digests of what stands before and behind the slot, so their number times their length never counts.

1. Marks of known mark-ups, wordings of filler, of messages of servers and programs and of notices that scripts are needed give the
   first cases. A sentence that speaks of marks (with words for marking, replacing or printing around them) is a mention and no case.
2. The sentences of these cases that are filler, messages or notices induce templates. Any sentence that is aligned with one of them, four
   words or more outside of the slot, is one too, whatever stands in its slot.
3. A blank, or a bare name in brackets, is an unfilled slot if the sentence is aligned with one that has a marked slot there, or if
   the template is filled in otherwise: at least two different fillings stand in its place elsewhere.

Texts are compared after compatibility normalisation, without zero-width characters and accents, in lower case, so damage of
that kind hides nothing. The wordings are looked for where a word that each of them needs is found (one automaton for all of them, on the
text as it is compared), which loses none. Whole texts are searched, never prefixes.

Defined results: null, empty and blank texts are no cases; repeated texts are judged alike; an empty table gives an
empty result; other columns are ignored; a bare name in angle brackets that is closed as a tag in the same text is mark-up.
"""

from __future__ import annotations

import re
import unicodedata
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, small

ZERO_WIDTH = "​‌‍⁠﻿­‎‏"

# Mark-up of a slot, on folded text.
MARKS = [
    r"\{\{[^{}\n]*\}\}", r"\{%[^%\n]*%\}", r"<%=?[^%\n]*%>", r"<<[^<>\n]*>>", r"\[\[[^\n]*?\]\]", r"@@[^@\n]+@@", r"\$\{[^{}\n]*\}",
    r"%[a-z][\w .\-\[\]]*%", r"__[a-z][\w .\-\[\]]*?__", r"\{[^{}\n]*:\?\}", r"<enter [^<>\n]*>", r"\[insert [^\n]*? here\]",
    r"\[your [^\[\]\n]*\]", r"(?<=\bdear )\[[a-z][a-z_ ]*\]",
    r"\[[^\n\]]*(?:\[\d+\][^\n\]]*)? eintragen\]", r"\[\W{0,3}\w{0,3}\W{0,3}\s?compl.{1,4}ter\s?:[^\]\n]*(?:\][^\]\n ]*)?\]",
]
# What may be a slot left blank or with a default; it is one where the template has a marked slot in another record.
WEAK = [r"_{3,}", r"\.{5,}", r"\[ *\]", r"\( *\)", r"\{[a-z_. ]+\}", r"(?<!\[)\[[a-z_. ]+\](?!\])", r"(?<!<)<[a-z_. ]+>(?!>)"]
# What a sentence says that speaks of a mark.
MENTIONS = [
    r"\bthe marks?\b", r"\bstands? for\b", r"\b(?:is|are) replaced by\b", r"\bit swaps\b", r"\bprinted form\b", r"\bprinter'?s\b", r"\bmailing program\b", r"\bcopyist\b",
    r"\bplaceholders? (?:is|are|was|were)\b",
]
# Filler in the place of content.
FILLER = [
    r"\blorem ipsum dolor\b", r"\b(?:(?:lorem|ipsum|dolor|sit|amet|veniat|quorta|consectetur|adipiscing|elit)[ ,.]+){4}", r"\btext to follow\b", r"\btbd(?:[ .,;]+tbd)+\b", r"\bsample text(?:[ .,]+sample text)+",
    r"\byour \w+ goes here\b", r"\bx{3,}(?: x{2,}){2,}", r"\basdf(?:[ ,.]+\w{3,4})*[ ,.]+(?:asdf|qwer)\b", r"\bblindtext fur\b|\bblindtext\b.*\bersetzen\b", r"\btexte provisoire\b.*\bremplacer\b",
    r"\btexto de relleno\b", r"ここに文章が入ります", r"\bthis (?:paragraph|text|sentence|line|page) (?:is|serves) only (?:here )?(?:to|as)\b",
]
# Messages of servers and programs.
ERRORS = [
    r"\binternal (?:server )?error\b[.:]? *(?:incident|$)", r"\bhttp/\d(?:\.\d)? \d{3}\b", r"\b50\d service unavailable\b", r"\b502 bad gateway\b",
    r"\byour session (?:has )?(?:timed out|expired)\b", r"\bsign in again to see\b", r"\btoo many requests from\b", r"\btraceback \(most recent call last\)", r"^\w*(?:key|value|type|index)error: ",
    r"\b40[13] forbidden\b", r"\berror \d{3}: ", r"\bthe requested (?:document|page|resource|url) (?:has|was|could|is)\b", r"\boops! *something went wrong", r"\bsomething went wrong while loading\b",
    r"\berror del servidor\b", "ページが見つかりません", r"\berreur \d{3} ?: ", r"\bder server antwortet nicht\b", r"\bsql error\b.*\bnear\b", r"\b404 not found\b", r"\bpage you asked for is not on this\b",
    r"\bfehler \d{3}: ", r"\bfatal: .*(?:connection reset|not found|denied)", r"\b(?:java|javax|org|com)(?:\.\w+)+(?:exception|error)\b", r"\btemporarily (?:down|unavailable)\b.*\b(?:maintenance|later)\b",
    r"\bsorry, the [\w ]+ could not be (?:shown|opened|loaded|fetched|found)\b", r"\bwe cannot find that page\b", r"\b504 gateway time-?out\b", r"^access denied\b", r"^(?:\d{3} (?:- )?)?page not found\b", r"\berror establishing a database connection\b", r"\b\d{3} - [\w ]+ unreachable\b", r"\bquery aborted\b", r"\bcould not be reached\. try again\b",
]
# Notices that scripts are needed.
SCRIPTS = [
    r"\bjavascript\b.*\b(?:requis|required|switched on|enabled?)\b", r"\b(?:enable|activate|allow|permit|unblock|switch on|turn on|active|aktivieren sie|включите) (?:javascript|scripts\b|script execution)", r"javascriptを有効", r"\bneeds scripts\b", r"\bturn them on in your browser\b",
    r"\byour browser (?:does not run|blocks) scripts\b", r"\bscripts and cookies must be\b", r"\bchecking your browser before\b", r"\bscripts are switched off\b", r"\bjs (?:is )?disabled\b", r"\bwithout (?:javascript|scripts)\b",
    r"<noscript\b", r"\bhave javascript\b",
]

FRAME = re.compile(r"<[^<>\n]{1,40}>")
_ZERO_WIDTH = re.compile(f"[{ZERO_WIDTH}]")
_ACCENT = re.compile("[\u0300-\u036f]+")


def fold(text: str) -> str:
    """The text as it is compared."""
    if text.isascii():
        return text.lower()
    text = _ZERO_WIDTH.sub("", text) if _ZERO_WIDTH.search(text) else text
    apart = unicodedata.normalize("NFKD", text)
    return (text if apart == text and not _ACCENT.search(apart) else unicodedata.normalize("NFC", _ACCENT.sub("", apart))).lower()


_MARK = re.compile("|".join(MARKS))
_WEAK = re.compile("|".join(WEAK))
_MENTION = re.compile("|".join(MENTIONS))
_WORDINGS = [(kind, re.compile(p, re.MULTILINE if p.startswith("^") else 0)) for kind, of in (("filler", FILLER), ("error", ERRORS), ("script", SCRIPTS)) for p in of]
_MAY_BE_MARK = re.compile(r"[{\[<@$]|__|%[a-z]|\.{5}|\( *\)|eintragen\]")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|(?<=。)|\n")


_WORD = re.compile(r"[-+]?\d+(?:[.,:]\d+)*(?![^\W_])|[^\W_]+|[^\w\s]|_+")
_HEX = re.compile(r"[0-9a-f]*\d[0-9a-f]*")
SLOT, DIGEST, WRITTEN, FIXED, SPAN = " \ue000 ", "\ue001", 60, 4, 3  # templates of more than WRITTEN words are told by digests
TEMPLATES = 500_000  # that a task holds; more are joined


def _alike(word: str) -> str:
    return "#" if (word[-1].isdigit() and word[0] in "+-0123456789") or (len(word) >= 6 and _HEX.fullmatch(word)) else word


def words_of(sentence: str) -> list[str]:
    """The words and signs of a folded sentence, with numbers and hexadecimal ids alike."""
    return [_alike(w) for w in _WORD.findall(sentence)]


def _digests(words: list[str]) -> list[str]:
    """Of the first none, one, two and so on of the words."""
    so_far = blake2b(digest_size=16)
    out = [so_far.hexdigest()]
    for w in words:
        so_far.update(f"{w} ".encode())
        out.append(so_far.hexdigest())
    return out


def _key(before: list[str], after: list[str]) -> str:
    """The template with these words around its slot."""
    if len(before) + len(after) <= WRITTEN:
        return " ".join(before) + SLOT + " ".join(after)
    return f"{DIGEST}{len(before)} {_digests(before)[-1]} {_digests(after[::-1])[-1]}"


def aligned(words: list[str]):
    """(key, i, j) of each template that a sentence may belong to: words i to j, up to three, are its slot. A template
    holds a word at least."""
    n = len(words)
    before, after = (_digests(words), _digests(words[::-1])) if n > WRITTEN else ([], [])
    for size in range(0, SPAN + 1):
        if n - size < 2:
            return
        for i in range(n - size + 1):
            if n - size > WRITTEN:
                yield f"{DIGEST}{i} {before[i]} {after[n - size - i]}", i, i + size
            else:
                yield " ".join(words[:i]) + SLOT + " ".join(words[i + size :]), i, i + size


def sentences(folded: str) -> list[str]:
    return [x for x in map(str.strip, _SENTENCE.split(FRAME.sub("\n", folded) if "<" in folded else folded)) if x]


def needed(pattern: str) -> list[str] | None:
    """Words (without blanks) of which any match of a pattern holds at least one; None if none can be told."""
    from re import _constants as c
    from re import _parser

    def of(parts) -> list[str] | None:
        best, run = None, ""

        def better(words: list[str] | None) -> None:
            nonlocal best
            if words and all(words) and (best is None or min(map(len, words)) > min(map(len, best))):
                best = words

        for op, value in [*parts, (None, None)]:
            if op is c.LITERAL:
                run += chr(value)
                continue
            better([max(run.split(), key=len, default="")])
            run = ""
            if op is c.SUBPATTERN:
                better(of(value[-1]))
            elif op is c.BRANCH:
                each = [of(b) for b in value[1]]
                better([w for e in each for w in e] if all(each) else None)
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
                better(of(value[2]))
        return best

    return of(_parser.parse(pattern))


def _automaton():
    """The automaton of the words that the wordings need, each with the numbers of its wordings; those of wordings that need none."""
    always, of = [], {}
    for i, (_, pattern) in enumerate(_WORDINGS):
        words = needed(pattern.pattern)
        if words is None:
            always.append(i)
        for w in words or []:
            of.setdefault(w, []).append(i)
    return _words_automaton(of), always


def _words_automaton(words: dict):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w, value in words.items():
        found.add_word(w, value)
    found.make_automaton()
    return found


def _around(segment: str, pattern: re.Pattern) -> tuple[list[str], list[str]]:
    """The words before and behind what `pattern` finds first."""
    m = pattern.search(segment)
    return words_of(segment[: m.start()]), words_of(segment[m.end() :])


def _template(segment: str, pattern: re.Pattern) -> str | None:
    """The key of a sentence whose slot is what `pattern` finds first."""
    before, after = _around(segment, pattern)
    return _key(before, after) if len(before) + len(after) >= 2 and any(w.isalpha() for w in before + after) else None


def judge(text: str, automaton=None) -> list[tuple[str, str, str | None]]:
    """(kind, segment, template key) of each suspicious segment; 'blank' ones rest with the alignment, 'mention' ones are no case.
    Without an automaton every wording is looked for."""
    out = []
    folded = fold(text)
    if automaton is None:
        chosen = range(len(_WORDINGS))
    else:
        chosen = sorted({i for _, numbers in automaton[0].iter(folded) for i in numbers} | set(automaton[1]))
    if chosen:
        flat = re.sub(r"\s+", " ", folded)
        bare = re.sub(r"\s+", " ", FRAME.sub(" ", flat)) if "<" in flat else None
        seen: dict[str, list[re.Pattern]] = {}
        for i in chosen:
            kind, pattern = _WORDINGS[i]
            # wording may run across line ends and tags; that of a line's beginning may not
            m = pattern.search(folded) if pattern.flags & re.MULTILINE else pattern.search(flat) or (bare and pattern.search(bare))
            if m:
                if kind not in seen:
                    out.append((kind, m.group(0), None))
                seen.setdefault(kind, []).append(pattern)
        if seen:
            for segment in sentences(folded):
                kind = next((k for k, patterns in seen.items() if any(p.search(segment) for p in patterns)), None)
                if kind and FIXED < len(words_of(segment)):
                    out.append(("induce", segment, kind))
    if _MAY_BE_MARK.search(folded) and (_MARK.search(folded) or _WEAK.search(folded)):
        for segment in _SENTENCE.split(folded):
            if _MARK.search(segment):
                mention = _MENTION.search(segment)
                out.append(("mention" if mention else "slot", segment.strip(), None if mention else _template(segment, _MARK)))
            elif (m := _WEAK.search(segment)) and not (m[0][0] == "<" and f"</{m[0][1:]}" in folded):
                if (key := _template(segment, _WEAK)) is not None:
                    out.append(("blank", segment.strip(), key))
    return out


def suspicious(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, segment, template) of the suspicious segments of all texts."""
    rows = documents.filter(F.col(text).isNotNull()).select(key, text)

    def run(batches):
        automaton = _automaton()
        for pdf in batches:
            found = [(k, *x) for k, t in zip(pdf[key], pdf[text]) for x in judge(t, automaton)]
            yield pd.DataFrame(found, columns=[key, "kind", "segment", "template"])

    return rows.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, kind string, segment string, template string")


def _alignments(documents: DataFrame, seeds: DataFrame, key: str, text: str) -> DataFrame:
    """(key, template, filling) of the sentences of all texts that are aligned with one of the templates of `seeds` (template,
    first, last, anchor). The templates are what a task holds, if they are few; else sentences and templates are joined."""
    rows = documents.filter(F.col(text).isNotNull()).select(key, text)
    known = seeds.limit(TEMPLATES + 1).toPandas()
    few = len(known) <= TEMPLATES
    keys, ends = (set(known["template"]), set(known["first"]) | set(known["last"])) if few else (None, None)
    # a text without any of them is aligned with none
    anchors = set(known["anchor"]) if few else {""}
    shared = documents.sparkSession.sparkContext.broadcast((keys, ends, None if "" in anchors or not anchors else anchors))

    def run(batches):
        keys, ends, anchors = shared.value
        if keys is not None and not keys:
            return
        automaton = _words_automaton({w: 1 for w in anchors}) if anchors else None
        for pdf in batches:
            found = []
            for k, t in zip(pdf[key], pdf[text]):
                folded = fold(t)
                if automaton is not None and next(automaton.iter(folded), None) is None:
                    continue
                for segment in sentences(folded):
                    if keys is not None and not any(e in ends for e in _ends(segment)):
                        continue
                    words = words_of(segment)
                    if len(words) > 2:
                        found += [(k, x, " ".join(words[i:j])) for x, i, j in aligned(words) if keys is None or x in keys]
            yield pd.DataFrame(found, columns=[key, "template", "filling"])

    out = rows.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, template string, filling string")
    return out if few else out.join(seeds.select("template").distinct(), "template", "left_semi")


def _ends(segment: str) -> tuple[str, str, str]:
    """The first two words, the last two, and the first and the last: a template with two words or more on a side of its slot keeps
    one of the former, one with a word on either side the latter."""
    head, tail = _WORD.findall(" ".join(segment.split(None, 2)[:2])), _WORD.findall(" ".join(segment.rsplit(None, 2)[-2:]))
    head, tail = [_alike(w) for w in head[:2]], [_alike(w) for w in tail[-2:]]
    return " ".join(head), "\n" + " ".join(tail), head[0] + "\n" + tail[-1]


def _kept(left: list[str], right: list[str], n_left: int, n_right: int) -> tuple[str | None, str | None]:
    """What any sentence of a template has among its `_ends`; left, right: its first and last words."""
    if n_left == n_right == 1:
        return left[0] + "\n" + right[-1], None
    return " ".join(left[:2]) if n_left > 1 else None, "\n" + " ".join(right[-2:]) if n_right > 1 else None


def _seeds(segments: DataFrame) -> DataFrame:
    """(template, kind, first, last, anchor) of the templates that suspicious segments induce; anchor is the longest word."""

    def run(batches):
        for pdf in batches:
            found = []
            for kind, segment, template in zip(pdf["kind"], pdf["segment"], pdf["template"]):
                if kind == "induce":
                    words = words_of(segment)
                    n, longest = len(words), sorted((k for k, w in enumerate(words) if w.isalpha()), key=lambda k: -len(words[k]))
                    for key, i, j in aligned(words):
                        anchor = next((words[k] for k in longest if not i <= k < j), None)
                        if n - j + i >= FIXED and anchor and 3 * (n - j + i) >= 2 * n:
                            found.append((key, template, *_kept(words[: min(i, 2)], words[max(j, n - 2) :], i, n - j), anchor))
                else:
                    left, right = _around(segment, _WEAK)
                    found.append((template, "blank", *_kept(left, right, len(left), len(right)), max((w for w in left + right if w.isalpha()), key=len)))
            yield pd.DataFrame(found, columns=["template", "kind", "first", "last", "anchor"]).drop_duplicates()

    kinds = segments.filter(F.col("kind").isin("induce", "blank")).select("kind", "segment", "template").distinct()
    return kinds.mapInPandas(run, "template string, kind string, first string, last string, anchor string").distinct()


def _written(found: DataFrame, segments: DataFrame) -> DataFrame:
    """`found` with its templates as text, those of digests from a sentence that induces them."""
    columns, induce = found.columns, segments.filter("kind = 'induce'").select("segment", F.sha2("segment", 256).alias("of")).distinct()

    def places(batches):
        for pdf in batches:
            each = [(of, words_of(segment)) for of, segment in zip(pdf["of"], pdf["segment"])]
            yield pd.DataFrame([(key, of, i, j) for of, words in each if len(words) > WRITTEN for key, i, j in aligned(words) if key[0] == DIGEST], columns=["template", "of", "i", "j"])

    def write(batches):
        for pdf in batches:
            of = [" ".join(words[:i]) + SLOT + " ".join(words[j:]) for words, i, j in zip(map(words_of, pdf["segment"]), pdf["i"], pdf["j"])]
            yield pdf.assign(template=of)[columns]

    digest = F.col("template").startswith(DIGEST)
    at = found.filter(digest).join(induce.mapInPandas(places, "template string, of string, i int, j int"), "template")
    at = at.groupBy(*columns).agg(F.min(F.struct("of", "i", "j")).alias("at")).select(*columns, "at.*").join(induce, "of")
    return found.filter(~digest).unionByName(at.mapInPandas(write, found.schema))


def templates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Induced templates of filler, messages and notices with a slot that is filled in at least two ways: template (the slot as
    '*'), kind, records, fillings."""
    segments = cut(suspicious(documents, key, text))
    seeds = cut(_seeds(segments).filter("kind <> 'blank'"))
    found = _alignments(documents, seeds, key, text).groupBy("template").agg(F.countDistinct(key).alias("records"), F.countDistinct("filling").alias("fillings"))
    kinds = seeds.groupBy("template").agg(F.min("kind").alias("kind"))
    several = cut(found.filter("fillings > 1").join(kinds, "template").select("template", "kind", "records", "fillings"))
    return _written(several, segments).select(F.replace("template", F.lit(SLOT), F.lit(" * ")).alias("template"), "kind", "records", "fillings")


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kinds): each document with an unfilled slot, filler, an error message or a notice about scripts."""
    segments = cut(suspicious(documents, key, text))
    direct = segments.filter(F.col("kind").isin("slot", "filler", "error", "script")).select(key, "kind")
    seeds = cut(_seeds(segments))
    hits = cut(_alignments(documents, seeds, key, text))
    # sentences of an induced template
    of = seeds.filter("kind <> 'blank'").groupBy("template").agg(F.min("kind").alias("kind"))
    induced = hits.join(small(of), "template").select(key, "kind")
    # blanks: as in a template with a marked slot, or one that is filled in otherwise
    blanks = segments.filter("kind = 'blank'").select(key, "template")
    marked = segments.filter("kind = 'slot' AND template IS NOT NULL").select("template").distinct()
    weak = F.col("filling").rlike("^[\\W_]*$")
    filled = hits.filter(~weak).groupBy("template").agg(F.countDistinct("filling").alias("n")).filter("n > 1").select("template")
    unfilled = blanks.join(marked.unionByName(filled).distinct(), "template", "left_semi").select(key, F.lit("slot").alias("kind"))
    judged = direct.unionByName(induced).unionByName(unfilled)
    return judged.groupBy(key).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of each document to exclude."""
    return residue(documents).select("doc_id")

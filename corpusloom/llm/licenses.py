"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser
evaluates the licence expressions that follow the tags.

Cases: a null text is as an empty one (no words, no labels, score 0). Texts of any length are scanned
whole, overlapping places all count, repeated rows each get a row. Columns of the input other than
the two named are dropped, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_bytes

# The phrases of the contract with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases with the label and the weight of each as evidence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "isc license": ("isc", 0.8),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.6),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
# Licences by the name of their identifiers: label, openness (1: no conditions, 0: no use), whether a version may follow (v) or what else GNU's may say (g), and the variants that are listed.
_LISTED = """
mit mit 1.0 - 0 cmu advertising enna feh festival modern-variant open-group wu
x11 mit 1.0 - distribute-modifications-variant swapped
0bsd bsd 1.0 -
bsd bsd 0.9 - 1-clause 2-clause 2-clause-patent 2-clause-views 3-clause 3-clause-attribution 3-clause-clear 3-clause-lbnl 3-clause-modification 3-clause-open-mpi 4-clause 4-clause-uc protection source-code
isc isc 1.0 - veillard
apache apache 0.9 v
cc0 cc0 1.0 v
unlicense public-domain 1.0 -
pddl public-domain 1.0 v
wtfpl wtfpl 1.0 v
cc-by-nc-nd cc-by-nc-nd 0.2 v 3.0-de 3.0-igo
cc-by-nc-sa cc-by-nc-sa 0.2 v 2.0-de 2.0-fr 2.0-uk 3.0-de 3.0-igo
cc-by-nc cc-by-nc 0.3 v 3.0-de
cc-by-nd cc-by-nd 0.3 v 3.0-de
cc-by-sa cc-by-sa 0.6 v 2.0-uk 2.1-jp 3.0-at 3.0-de 3.0-igo
cc-by cc-by 0.9 v 2.5-au 3.0-at 3.0-au 3.0-de 3.0-igo 3.0-nl 3.0-us
mpl mpl 0.6 v 2.0-no-copyleft-exception
epl epl 0.6 v
cddl cddl 0.6 v
eupl eupl 0.5 v
lgpl lgpl 0.6 g
agpl agpl 0.2 g
gpl gpl 0.4 g
gfdl gfdl 0.4 g
lgpllr lgpl 0.6 -
zlib zlib 1.0 - acknowledgement
libpng libpng 1.0 v
artistic artistic 0.8 v 1.0-cl8 1.0-perl
bsl boost 1.0 v
psf python 0.9 v
python python 0.9 v
postgresql postgresql 1.0 -
ncsa ncsa 0.9 -
openssl openssl 0.8 - standalone
ofl ofl 0.8 v 1.0-rfn 1.0-no-rfn 1.1-rfn 1.1-no-rfn
odbl odbl 0.6 v
odc-by odc-by 0.9 v
cdla-permissive cdla 0.9 v
cdla-sharing cdla 0.6 v
ms-pl ms-pl 0.8 -
ms-rl ms-rl 0.6 -
osl osl 0.3 v
afl afl 0.8 v
upl upl 1.0 v
ecl ecl 0.9 v
blueoak blueoak 1.0 v
mulanpsl mulan 0.9 v
cecill cecill 0.4 v b c
zpl zope 0.9 v
php php 0.8 v
ruby ruby 0.8 -
vim vim 0.7 -
curl curl 1.0 -
hpnd hpnd 0.9 - sell-variant
ntp ntp 1.0 - 0
w3c w3c 0.9 -
bzip2 bzip2 0.9 v
unicode-dfs unicode 0.9 v 2015 2016
unicode unicode 0.9 v
sspl sspl 0.1 v
busl busl 0.1 v
elastic elastic 0.1 v
json json 0.5 -
proprietary proprietary 0.0 -
"""
IDENTIFIERS = {name: (label, float(openness)) for name, label, openness, *_ in map(str.split, _LISTED.strip().split("\n"))}
_NUMBER = r"(?:[-.]?v?[0-9]+(?:\.[0-9]+){0,3})?"
#: Each name with its listed variants, or a version where it has any; a final + means later versions too.
_WHOLE = {
    name: re.compile(f"{re.escape(name)}(?:{'|'.join(['', *(re.escape(f'-{v}') for v in variants)])}{'' if how == '-' else '|' + _NUMBER}){'(?:-only|-or-later|-invariants-only|-no-invariants-only)?' if how == 'g' else ''}\\+?")
    for name, _, _, how, *variants in map(str.split, _LISTED.strip().split("\n"))
}
TAGS = ("spdx-license-identifier:", "license-expression:")
# Exceptions that loosen the licence beside them, by their name without a version.
EXCEPTIONS = ("autoconf-exception", "bison-exception", "classpath-exception", "font-exception", "gcc-exception", "linux-syscall-note", "llvm-exception", "openssl-exception")
_EXCEPTION = re.compile(rf"({'|'.join(map(re.escape, EXCEPTIONS))}){_NUMBER}")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
BASE_WEIGHT, TAG_WEIGHT, BROKEN_TAG_WEIGHT = 0.9, 0.95, 0.4

#: Keeps 0-9, a-z and bytes from 0x80, lower-cases A-Z, makes blanks of the rest.
_WORDS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, openness double"


def parse(text: str) -> list[str] | None:
    """The expression at the start of text in postfix form; None if it is malformed or missing.

    It ends before the first token that can't stand where it does.
    """
    out: list[str] = []
    held: list[str] = []
    operand, at = True, 0
    while m := _TOKEN.match(text, at):
        token = m[1].rstrip(".:") or m[1]
        if operand:
            if token == "(":
                held.append(token)
            elif token == ")" or token in PRECEDENCE:
                break
            else:
                out.append(token)
                operand = False
        elif token == ")":
            if "(" not in held:
                break
            while (top := held.pop()) != "(":
                out.append(top)
        elif token in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            break
        at = m.end()
    if operand or "(" in held:
        return None
    return out + held[::-1]


def named(token: str) -> str | None:
    """The listed licence that an identifier is, as a whole: a name, a listed variant of it or a version; none for anything else."""
    return next((name for name, whole in _WHOLE.items() if token.startswith(name) and whole.fullmatch(token)), None)


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels and openness: an offer (or) is as open as its best side, a sum (and) as its worst.

    A known exception (with) loosens the licence that it stands beside, to 0.6 at least. Identifiers that aren't listed count as unknown.
    """
    stack: list[tuple[set[str], float, str]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            name = named(token)
            label, openness = IDENTIFIERS[name] if name else ("unknown", 0.5)
            stack.append(({label}, openness, token))
            continue
        (right, b, exception), (left, a, _) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, max(a, 0.6) if _EXCEPTION.fullmatch(exception) else a, ""))
        else:
            stack.append((left | right, min(a, b) if token == "and" else max(a, b), ""))
    return stack[0][:2]


def _automaton(keys: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, value in keys.items():
        out.add_word(key, value)
    out.make_automaton()
    return out


def scan(texts: Iterator[bytes | None], phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> Iterator[tuple]:
    """A row of SCHEMA without doc_id for each UTF-8 text."""
    for raw in texts:
        raw = raw or b""
        words = raw.translate(_WORDS).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        places, base, labels, weights = [], set(), set(), {}
        at = blanks = 0
        for end, (phrase, label, weight, is_base) in phrases.iter(line):
            start = end - len(phrase) + 1
            labels.add(label)
            weights[phrase] = weight
            if is_base:
                base.add(label)
                # blanks before this place are counted on from the last one, which may lie behind it
                blanks += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
                at = start
                places.append(blanks)
        expressions, openness = [], None
        low = raw.lower().decode("latin-1")
        for end, tag in tags.iter(low):
            stop = low.find("\n", end)
            postfix = parse(low[end + 1 : stop if stop >= 0 else len(low)])
            weights[tag] = max(weights.get(tag, 0), TAG_WEIGHT if postfix else BROKEN_TAG_WEIGHT)
            if postfix:
                found, value = evaluate(postfix)
                labels |= found
                expressions.append(" ".join(postfix))
                openness = value if openness is None else min(openness, value)
        rest = 1.0
        for _, weight in sorted(weights.items()):
            rest *= 1 - weight
        yield len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - rest, expressions, openness


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: see SCHEMA.

    n_base counts the places of BASE phrases; labels has the method's labels too; score says how strong
    the evidence for any licence is (independent pieces, noisy or); expressions are in postfix form;
    openness is that of the strictest expression, null without one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = {f" {k} ": (f" {k} ", *v, False) for k, v in NOTICES.items()} | {f" {k} ": (f" {k} ", v, BASE_WEIGHT, True) for k, v in BASE.items()}
        phrases, tags = _automaton(entries), _automaton({t: t for t in TAGS})
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.float64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            columns = list(zip(*scan(batch[1].to_pylist(), phrases, tags), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(docs[id_column].cast("long"), text_bytes(text_column)).mapInArrow(rows, SCHEMA)

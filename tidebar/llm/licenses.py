"""License scans by ordered signature rules.

A rule is a label, a priority and a regular expression over words: texts are matched
with every run of blanks, comment marks and punctuation, of any length, as one blank.
A rule's keywords are words that every match holds, taken from the expression. All
keywords of all rules are looked up in one pass of an Aho-Corasick automaton over the
lower-cased text; only rules with a keyword present run, and only around its hits, as
far as the rule's longest match can reach. Short identifiers are read from the line
that declares them. Detections are intervals of the text. They are resolved in order
of priority, then length, then place: one that lies inside a kept detection of
at least its priority is suppressed ("GPL" inside "GNU Lesser General Public
License"). The labels of what remains are the document's.

``base phrases`` are counted apart, over words: maximal runs of a-z, 0-9 and
non-ASCII characters of the lower-cased text. Their labels always stay.

The score is 1 - product of (1 - weight) over the distinct labels, the weight
following the priority of the label's strongest detection: 0 without any.

Defined results: a null text counts as empty: no words, no labels, score 0. Null
ids and repeated rows are rows like others. Very long texts are whole and take time
in proportion. Detections that tie in priority, length and place keep the first label
by name. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, pieces

BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: What is matched: words, and two signs of copyright; all else between them is one blank.
_TOKEN = re.compile(r"\(c\)|©|[^\W_]+")

# Signatures. Each line: label | priority | expression (on lower-cased words;
# a blank stands for all that is between two words).
# Priority: 9 identifiers, 8 full titles with version, 7 distinctive sentences, 5 titles, 3 short names, 2 hints.
_SIGNATURES = r"""
mit|5|(the )?mit license
mit|7|permission is hereby granted free of charge to any person obtaining a copy
mit|7|copyright notice and this permission notice shall be included in all copies or substantial portions
mit|3|licensed under (the )?mit
mit-0|8|mit no attribution
x11|5|x11 license
expat|5|expat license
isc|5|(the )?isc license
isc|7|permission to use copy modify and or distribute this software for any purpose with or without fee
0bsd|8|(bsd zero clause|zero clause bsd|0bsd)( license)?
bsd-2-clause|8|(simplified bsd|freebsd|(2|two) clause bsd|bsd (2|two) clause)( license)?
bsd-3-clause|8|(new bsd|revised bsd|modified bsd|(3|three) clause bsd|bsd (3|three) clause)( license)?
bsd-4-clause|8|(original bsd|(4|four) clause bsd|bsd (4|four) clause)( license)?
bsd|5|bsd (style )?license
bsd|7|redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause|7|may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|7|all advertising materials mentioning features or use of this software must display
apache-2.0|8|apache (software )?(license )?(version |v ?)?2 0
apache-2.0|7|licensed under the apache license
apache-2.0|8|apache org licenses license 2 0
apache-1.1|8|apache (software )?(license )?(version |v ?)?1 1
apache-1.0|8|apache (software )?(license )?(version |v ?)?1 0
apache|5|apache (software )?license
apache|3|(under|apache) (the )?apache 2
gpl-3.0|8|gnu general public license (as published by the free software foundation )?(either )?(version|v) ?3
gpl-2.0|8|gnu general public license (as published by the free software foundation )?(either )?(version|v) ?2
gpl-1.0|8|gnu general public license (as published by the free software foundation )?(either )?(version|v) ?1
gpl|5|(gnu )?general public license
gpl-3.0|8|gpl ?(v ?|version )?3
gpl-2.0|8|gpl ?(v ?|version )?2
gpl|3|(licensed under|released under|terms of) (the )?(gnu )?gpl
gpl|7|you can redistribute it and or modify it under the terms of the gnu general public license
gpl-linking-exception|8|gpl ?((v ?)?[23] )?(with )?(classpath|linking) exception
lgpl-3.0|8|(gnu lesser general public license (version|v) ?3|lgpl ?(v ?|version )?3)
lgpl-2.1|8|(gnu lesser general public license (version|v) ?2 1|lgpl ?(v ?|version )?2 1)
lgpl-2.0|8|gnu library general public license (version|v) ?2
lgpl|6|(gnu )?(lesser|library) general public license
lgpl|3|(licensed|released) under (the )?(gnu )?lgpl
agpl-3.0|8|(gnu affero general public license (version|v) ?3|agpl ?(v ?|version )?3)
agpl|6|(gnu )?affero general public license
agpl|3|(licensed|released) under (the )?(gnu )?agpl
fdl-1.3|8|gnu free documentation license (version|v) ?1 3
fdl-1.2|8|gnu free documentation license (version|v) ?1 2
fdl|5|(gnu )?free documentation license
mpl-2.0|8|(mozilla public license (version ?|v ?)?2 0|mpl ?(v ?|version )?2 0)
mpl-1.1|8|(mozilla public license (version ?|v ?)?1 1|mpl ?(v ?|version )?1 1)
mpl-1.0|8|mozilla public license (version ?|v ?)?1 0
mpl|5|mozilla public license
mpl-2.0|7|this source code form is subject to the terms of the mozilla public license
epl-2.0|8|(eclipse public license (version ?|v ?)?2 0|epl ?(v ?|version )?2 0)
epl-1.0|8|(eclipse public license (version ?|v ?)?1 0|epl ?(v ?|version )?1 0)
epl|5|eclipse public license
edl-1.0|8|eclipse distribution license( (version ?|v ?)?1 0)?
cddl-1.1|8|(common development and distribution license|cddl) (version ?|v ?)?1 1
cddl-1.0|8|(common development and distribution license|cddl) (version ?|v ?)?1 0
cddl|5|common development and distribution license
cpl-1.0|8|common public license( (version ?|v ?)?1 0)?
cpal-1.0|8|common public attribution license( (version ?|v ?)?1 0)?
ipl-1.0|8|ibm public license( (version ?|v ?)?1 0)?
eupl-1.2|8|(european union public licence|eupl) (version ?|v ?)?1 2
eupl-1.1|8|(european union public licence|eupl) (version ?|v ?)?1 1
eupl|5|european union public licen[cs]e
osl-3.0|8|open software license (version ?|v ?)?3 0
osl|5|open software license
afl-3.0|8|academic free license (version ?|v ?)?3 0
afl|5|academic free license
artistic-2.0|8|artistic license (version ?|v ?)?2 0
artistic-1.0|8|artistic license (version ?|v ?)?1 0
artistic|5|(the )?artistic license
perl|5|(under the )?same terms as perl( itself)?
bsl-1.0|8|boost software license( (version ?|v ?)?1 0)?
busl-1.1|8|business source license( (version ?|v ?)?1 1)?
sspl-1.0|8|(server side public license|sspl)( (version ?|v ?)?1)?
elastic-2.0|8|elastic license( (version ?|v ?)?2 0)?
commons-clause|8|commons clause( license condition)?
polyform|8|polyform (noncommercial|small business|free trial|shield|perimeter|strict|internal use) license
unlicense|5|(the )?unlicense
unlicense|7|this is free and unencumbered software released into the public domain
wtfpl|8|(wtfpl|do what the fuck you want to public license)
zlib|8|zlib( libpng)? licen[cs]e
zlib|7|this software is provided as is without any express or implied warranty
libpng|8|(png reference library|libpng) license
openssl|8|openssl license
ssleay|8|(original )?ssleay license
openldap|8|openldap public license
php-3.01|8|php license( (version ?|v ?)?3 01)?
python-2.0|8|(python software foundation license|psf license)( (version ?|v ?)?2)?
ruby|8|ruby( s)? license
postgresql|8|postgresql licen[cs]e
sleepycat|8|sleepycat license
vim|8|vim license
curl|8|curl license
ijg|8|independent jpeg group( s)?( license)?
freetype|8|(the )?freetype (project )?license
imagemagick|8|imagemagick license
json|8|software shall be used for good not evil
beerware|8|beer ?ware license
ncsa|8|(university of )?(illinois )?ncsa open source license
ms-pl|8|microsoft public license
ms-rl|8|microsoft reciprocal license
ms-eula|5|microsoft software license terms
apsl-2.0|8|apple public source license( (version ?|v ?)?2 0)?
qpl-1.0|8|q public license( (version ?|v ?)?1 0)?
sil-ofl-1.1|8|(sil )?open font license( (version ?|v ?)?1 1)?
gust-font|8|gust font license
bitstream-vera|8|bitstream vera( fonts?)? (license|copyright)
ubuntu-font|8|ubuntu font licen[cs]e
upl-1.0|8|universal permissive license( (version ?|v ?)?1 0)?
w3c|8|w3c software (notice and )?(document )?license
unicode|8|unicode( inc)? license agreement
mulan-psl-2.0|8|mulan permissive software license( (version ?|v ?)?2)?
cecill-2.1|8|cecill (free software license agreement )?(version ?|v ?)?2 1
cecill|5|cecill( b| c)?( license)?
ecl-2.0|8|educational community license( (version ?|v ?)?2 0)?
nposl|8|non profit open software license
rpl-1.5|8|reciprocal public license( 1 5)?
simpl-2.0|8|simple public license( 2 0)?
zpl-2.1|8|zope public license( (version ?|v ?)?2 1)?
ntp|8|ntp license
hpnd|8|historical permission notice and disclaimer
bzip2|8|bzip2 license
lppl-1.3c|8|latex project public license( (version ?|v ?)?1 3c?)?
oldap|8|oldap( 2 8)?
cc0-1.0|8|(cc0|creative commons zero)( (version ?|v ?)?1 0)?( universal)?
cc-by-nc-nd|8|(cc by nc nd|attribution non ?commercial no ?deriv(ative)?s)( ?[234] ?[05])?
cc-by-nc-sa|8|(cc by nc sa|attribution non ?commercial share ?alike)( ?[234] ?[05])?
cc-by-nc|7|(cc by nc|attribution non ?commercial)( ?[234] ?[05])?
cc-by-nd|7|(cc by nd|attribution no ?deriv(ative)?s)( ?[234] ?[05])?
cc-by-sa|7|(cc by sa|attribution share ?alike)( ?[234] ?[05])?
cc-by-4.0|6|(cc by|creative commons attribution) 4 0( international)?
cc-by-3.0|6|(cc by|creative commons attribution) 3 0( unported)?
cc-by-2.0|6|(cc by|creative commons attribution) 2 0( generic)?
cc|3|creative commons( license)?
cc-url|9|creativecommons org (licenses|publicdomain) [a-z]+( [a-z]+){0,2} [1-4] 0
odbl-1.0|8|(open database license|odbl)( (version ?|v ?)?1 0)?
odc-by-1.0|8|(open data commons attribution license|odc by)( (version ?|v ?)?1 0)?
pddl-1.0|8|(public domain dedication and license|pddl)( (version ?|v ?)?1 0)?
cdla-permissive|8|(community data license agreement permissive|cdla permissive)
cdla-sharing|8|(community data license agreement sharing|cdla sharing)
ogl-uk-3.0|8|open government licen[cs]e( (version ?|v ?)?3 0)?
etalab-2.0|8|(etalab open licen[cs]e|licence ouverte)( (version ?|v ?)?2 0)?
dl-de-by-2.0|8|datenlizenz deutschland (namensnennung|zero)( (version ?|v ?)?2 0)?
openrail|8|(bigscience |creativeml )?open ?rail( m| d)?( license)?
llama-community|8|llama ([23] )?community license( agreement)?
gemma-terms|8|gemma terms of use
public-domain|5|(in|into|to) the public domain
public-domain|3|public domain
proprietary|5|proprietary and confidential
proprietary|3|proprietary (software|license|information)
trade-secret|5|(contains|constitutes?) (confidential )?(information and )?trade secrets?
no-redistribution|7|(unauthori[sz]ed|no) (copying|reproduction|redistribution)( or (copying|redistribution|distribution))?( of this (file|work|document))?( is| are)? (strictly )?(prohibited|permitted|allowed)
no-commercial|6|(non ?commercial use only|commercial use (is )?(strictly )?(prohibited|not permitted|forbidden)|for non ?commercial (use|purposes))
research-only|6|for (academic|research)( and| or)?( (academic|research|educational))? (use|purposes) only
educational-only|6|for educational (use|purposes) only
evaluation-only|6|for evaluation (use|purposes) only
personal-use|6|for (your )?personal (use|non commercial use) only
reserved|7|all rights reserved
reserved|5|(some|certain|no) rights reserved
alle-rechte|7|alle rechte vorbehalten
tous-droits|7|tous droits r[eé]serv[eé]s
todos-derechos|7|todos los derechos reservados
copyright|3|copyright (\(c\) |c |© )?((19|20)[0-9]{2})( (19|20)?[0-9]{2,4})?
copyright|3|© ?((19|20)[0-9]{2})
copyright|2|\(c\) ?((19|20)[0-9]{2})
disclaimer|7|without warranty of any kind( express or implied)?
disclaimer|7|(implied )?warrant(y|ies) of merchantability( and| or)?( fitness for a particular purpose)?
disclaimer|7|provided (on an )?as is (basis|without)?
liability|7|in no event shall (the )?(authors?|copyright (holders?|owners?)|regents|contributors?)
patent-grant|7|(royalty free|irrevocable|perpetual)( worldwide)?( non exclusive)? patent license
copyleft|5|copyleft
dual|5|dual licensed( under)?
eula|5|end user licen[cs]e agreement
license-file|3|see (the )?(accompanying )?(licen[cs]e|copying)( txt| md)?( file)?( for)?
terms-of-use|3|(subject to|governed by)( the| our)? terms of (use|service)
licensed-under|2|licensed under (the |a )?[a-z0-9]+
lizenz|3|lizenziert unter( der)?
licence-fr|3|sous licence( libre)?
licencia-es|3|bajo (la )?licencia
"""

# Identifiers of the short-identifier notation; each gives one rule of priority 9.
_IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 "
    "BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 "
    "CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 "
    "EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only "
    "GPL-3.0-or-later HPND ICU IJG ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP ODbL-1.0 ODC-By-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-3.0 "
    "PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL "
    "X11 Zlib ZPL-2.1"
)
_WEIGHT = {9: 0.95, 8: 0.9, 7: 0.8, 6: 0.7, 5: 0.6, 3: 0.4, 2: 0.2}
_SPDX = "spdx-license-identifier"
_DECLARED = re.compile(_SPDX + r"\s*:([^\n]*)")
_NAME = re.compile(r"[\w.+-]+")


@dataclass(frozen=True)
class Rule:
    """One signature; ``order`` is its place in the list."""

    order: int
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


def _expression(spelled: str) -> str:
    """Matches of the spelled form begin and end with words."""
    return r"(?<!\w)" + spelled + r"(?!\w)"


def needed(expression: str) -> set[str]:
    """Strings without gaps of which every match of the expression holds one: its keywords."""

    def of(items) -> set[str] | None:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is parser.LITERAL and value != ord(" "):
                run += chr(value)
                continue
            if run:
                found.append({run})
                run = ""
            if op is parser.SUBPATTERN:
                found.append(of(value[-1]))
            elif op is parser.BRANCH:
                each = [of(x) for x in value[1]]
                found.append(None if None in each else set().union(*each))
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
        return max((x for x in found if x), key=lambda x: min(map(len, x)), default=None)

    words = of(parser.parse(expression))
    if words is None:
        raise ValueError(f"no keyword in {expression}")
    return words


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signatures in order, identifiers first."""
    found = []
    for name in _IDENTIFIERS.split():
        found.append(Rule(len(found), name.lower(), 9, (_SPDX,), re.compile(re.escape(name.lower()))))
    for line in _SIGNATURES.strip().splitlines():
        label, priority, spelled = line.split("|", 2)
        expression = _expression(spelled.lower())
        found.append(Rule(len(found), label, int(priority), tuple(sorted(needed(expression))), re.compile(expression)))
    return tuple(found)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    by_word: dict[str, list[int]] = {}
    for rule in rules():
        for word in rule.keywords:
            by_word.setdefault(word, []).append(rule.order)
    automaton = ahocorasick.Automaton()
    for word, orders in by_word.items():
        automaton.add_word(word, tuple(orders))
    automaton.make_automaton()
    return automaton


def _lower(text: str) -> str:
    """A-Z lower-cased, so that places stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Detection:
    """A rule's match: ``start`` and ``end`` in characters."""

    label: str
    priority: int
    start: int
    end: int


def _windows(hits: list[int], reach: int, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for at in sorted(hits):
        a, b = max(0, at - reach), min(size, at + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@lru_cache(maxsize=1)
def _reach() -> tuple[int, ...]:
    """How far a match of each rule can reach from a place inside it."""
    return tuple(parser.parse(r.pattern.pattern).getwidth()[1] + 1 for r in rules())


@lru_cache(maxsize=1)
def _identifiers() -> dict[str, Rule]:
    return {r.label: r for r in rules() if r.keywords == (_SPDX,)}


def _declared(lowered: str) -> set[Detection]:
    """Identifiers that declaring lines name, joined by ``or``, ``and`` and ``with``."""
    out: set[Detection] = set()
    for line in _DECLARED.finditer(lowered):
        joined = True
        for m in _NAME.finditer(lowered, *line.span(1)):
            if m[0] in ("or", "and", "with"):
                joined = True
            elif joined:
                joined = False
                if m[0] in _identifiers():
                    out.add(Detection(m[0], 9, m.start(), m.end()))
            else:
                break  # the line goes on with other words
    return out


def detect(text: str) -> list[Detection]:
    """Kept detections of a text, by place."""
    lowered = _lower(text)
    hits: dict[int, list[int]] = {}
    for end, orders in _automaton().iter(lowered):
        for order in orders:
            hits.setdefault(order, []).append(end)
    if not hits:
        return []
    raw = _declared(lowered) if any(rules()[order].keywords == (_SPDX,) for order in hits) else set()
    tokens = list(_TOKEN.finditer(lowered))
    spelled = " ".join([m[0] for m in tokens])
    places = [m.start() for m in tokens]
    own = list(accumulate((len(m[0]) + 1 for m in tokens), initial=0))  # where each token starts in ``spelled``
    inside = lambda at: (k := bisect_right(places, at) - 1) >= 0 and (k, own[k] + at - places[k])
    back = lambda at: (k := bisect_right(own, at) - 1, places[k] + at - own[k])[1]
    for order, ends in hits.items():
        rule = rules()[order]
        if rule.keywords == (_SPDX,):
            continue
        at = [where[1] for where in map(inside, ends) if where]
        for a, b in _windows(at, min(_reach()[order], len(spelled)), len(spelled)):
            raw.update(Detection(rule.label, rule.priority, back(m.start()), back(m.end() - 1) + 1) for m in rule.pattern.finditer(spelled, a, b))
    return resolve(raw)


def resolve(raw) -> list[Detection]:
    """Drops detections that lie inside a kept one, which has at least their priority."""
    starts = sorted({d.start for d in raw})
    reach = [-1] * (len(starts) + 1)  # a tree of prefix maxima: how far kept detections reach that start up to a place
    kept: list[Detection] = []
    for d in sorted(raw, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        k = at = bisect_right(starts, d.start)
        most = -1
        while k:
            most = max(most, reach[k])
            k &= k - 1
        if most >= d.end:
            continue
        kept.append(d)
        while at <= len(starts):
            reach[at] = max(reach[at], d.end)
            at += at & -at
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def base_places(lowered: bytes) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (first word, label) of every base phrase. ``lowered``: A-Z lower-cased UTF-8."""
    words = _WORD.findall(lowered)
    places = []
    for phrase, label in BASE.items():
        if phrase[0].encode() not in lowered or phrase[-1].encode() not in lowered:
            continue
        parts = [p.encode() for p in phrase]
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                places.append((at, label))
    return len(words), sorted(places)


def score(found: list[Detection], base: set[str]) -> float:
    best: dict[str, int] = {label: 7 for label in base}
    for d in found:
        best[d.label] = max(best.get(d.label, 0), d.priority)
    clear = 1.0
    for priority in best.values():
        clear *= 1.0 - _WEIGHT[priority]
    return 1.0 - clear


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("detections", pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _row(raw: bytes) -> tuple:
    lowered = raw.lower()
    n_words, places = base_places(lowered)
    base = {label for _, label in places}
    found = detect(raw.decode("utf-8", "surrogatepass"))
    labels = base | {d.label for d in found}
    spans = [{"label": d.label, "priority": d.priority, "start": d.start, "end": d.end} for d in found]
    first, last = (places[0][0], places[-1][0]) if places else (None, None)
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score(found, base), spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and phrase counts, labels, score and the kept detections with their places."""
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                columns = list(zip(*(_row(t) for t in byte_values(batch.column(1)))))
                yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:]))], schema=_SCHEMA)

    return kept.mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "detections array<struct<label: string, priority: int, start: bigint, end: bigint>>",
    )

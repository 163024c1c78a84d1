"""License scans by sentence rules.

A text is cut into sentences; each is normalised and the known licence sentences are searched in it,
wherever they stand and however long it is: a text without full stops or newlines is one sentence. The
identifiers of a text, in order, are then matched against ordered licence rules; what a rule takes
is gone for the rules after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: What a sentence must hold to be looked at: of every known sentence, a word that all its forms have. Quotes and
#: white space between words are still as they stand in the text.
TRIGGER = re.compile(
    r"licen[cs]|copyright|\(c\)|©|warrant|permission|redistribut|reserved|domain|unencumbered|spdx|provided|endorse|substantial|creative|misrepresented"
    r"|version\s+[23](?:\.0)?,\s+(?:\d+\s+)?(?:january|june|november)\b"
    r"|\b(?:cc0|wtfpl|epl|eupl|cddl|[al]?gpl|mpl|bsd|mit\b|cc[\s\"'`“”‘’-]+(?:by|attribution))",
    re.I | re.A,
)
#: A run of white space is looked at from its beginning only, so that cutting takes time in proportion to the text.
BOUNDARY = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])\s*|(?<!\s)\s*\n\s*(?:\n|[*#/;-]+\s)\s*|\n")
LEADING, TRAILING, QUOTES = re.compile(r"[\s*#/;<>!|-]+"), "*#/|>-", str.maketrans("", "", "\"'`“”‘’")

_LATER = r"(?:\+|,? (?:or|and) (?:\(?at your option\)?,? )?(?:any )?(?:later|newer)(?: versions?)?)"
_VER = r"(?:,?(?: -)? ?\(?(?:version|v\.?|ver\.?)? ?%s(?:\.0)?(?!\.?\d)\)?)"
_NO_VER = r"(?!,?(?: -)? ?\(?(?:version|v\.?|ver\.?)? ?\d)"
_APACHE = r"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? license"
#: Licences of an SPDX expression, with brackets and operators between them.
_SPDX = r"(?:\( ?)*[\w.+-]+(?: ?\))*"
#: Known sentences, as patterns of a whole normalised sentence, in the order they are tried.
SENTENCES: list[tuple[str, str]] = [
    ("SPDX", rf"(?:.*\W)?spdx-license-identifier: ?(?P<name>{_SPDX}(?: (?:and|or|with) {_SPDX})*).*"),
    ("ApacheRef2", rf".*\b(?:{_APACHE}(?:{_VER % 2}|{_NO_VER})|apache(?: license)?[ -]v?2(?:\.0)?[ -]licen[cs]ed\b).*"),
    ("ApacheRef11", rf".*\b{_APACHE}{_VER % '1.1'}.*"),
    ("ApacheRef1", rf".*\b{_APACHE}{_VER % 1}.*"),
    ("Version3Plus", rf"(?:either )?version 3(?:\.0)? of the license{_LATER}.*"),
    ("Version21Plus", rf"(?:either )?version 2\.1 of the license{_LATER}.*"),
    ("Version2Plus", rf"(?:either )?version 2(?:\.0)? of the license{_LATER}.*"),
    ("AGPLRef3Plus", rf".*\b(?:gnu )?(?:affero general public license|agpl){_VER % 3}{_LATER}.*"),
    ("LGPLRef3Plus", rf".*\b(?:gnu )?(?:lesser general public license|lgpl){_VER % 3}{_LATER}.*"),
    ("LGPLRef21Plus", rf".*\b(?:gnu )?(?:lesser general public license|lgpl){_VER % '2.1'}{_LATER}.*"),
    ("AGPLRef3", rf".*\b(?:gnu )?(?:affero general public license|agpl){_VER % 3}.*"),
    ("LGPLRef3", rf".*\b(?:gnu )?(?:lesser general public license|lgpl){_VER % 3}.*"),
    ("LGPLRef21", rf".*\b(?:gnu )?(?:lesser general public license|lgpl){_VER % '2.1'}.*"),
    ("GPLRef3Plus", rf".*\b(?:gnu )?(?:general public license|gpl){_VER % 3}{_LATER}.*"),
    ("GPLRef2Plus", rf".*\b(?:gnu )?(?:general public license|gpl){_VER % 2}{_LATER}.*"),
    ("GPLRef3", rf".*\b(?:gnu )?(?:general public license|gpl){_VER % 3}\b.*"),
    ("GPLRef2", rf".*\b(?:gnu )?(?:general public license|gpl){_VER % 2}\b.*"),
    ("AGPLRef", r".*\bgnu affero general public license.*"),
    ("LGPLRef", r".*\bgnu (?:lesser|library) general public license.*"),
    ("GPLRef", r".*\bgnu general public license.*"),
    ("MITRef", r".*\b(?:(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: license)?|mit[ -]licen[cs]ed)\b.*"),
    ("MITGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software.*"),
    ("MITNotice", r"(?:the above copyright notice and this permission notice .*)?shall be included in all copies or substantial portions of the software.*|the above copyright notice and this permission notice shall be included.*"),
    ("AsIs", r"(?:the|this) software is provided (?:by .* )?as is.*"),
    ("ISCGrant", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted.*"),
    ("BSDGrant", r"redistribution and use in source and binary forms, with or without modification, are permitted.*"),
    ("BSDSource", r"(?:\d[.)] )?redistributions of source code must retain.*"),
    ("BSDBinary", r"(?:\d[.)] )?redistributions in binary form must reproduce.*"),
    ("BSDNoEndorse", r"(?:\d[.)] )?neither the name of .* may be used to endorse.*"),
    ("BSDRef3", r".*\bunder (?:the )?(?:terms of )?(?:the )?(?:3-clause bsd|bsd 3-clause|new bsd|modified bsd)(?: license)?.*"),
    ("BSDRef2", r".*\bunder (?:the )?(?:terms of )?(?:the )?(?:2-clause bsd|bsd 2-clause|simplified bsd)(?: license)?.*"),
    ("BSDRef", r".*\bunder (?:the )?(?:terms of )?(?:the|a) bsd(?:-style)? license.*"),
    ("MPLRef2", r".*\b(?:mozilla public license|mpl),? ?(?:version |v\.? ?)?2(?:\.0)?(?!\.?\d).*"),
    ("CCRef", r".*\b(?:cc|creative commons)[ -](?P<name>by(?:-nc)?(?:-nd|-sa)?|attribution(?:-noncommercial)?(?:-noderivs|-noderivatives|-sharealike)?)[ ,]*(?:licen[cs]e )?(?:v(?:ersion)? ?)?(?P<version>[1-4]\.\d)?.*"),
    ("EPLRef2", rf".*\b(?:eclipse public license|epl){_VER % 2}.*"),
    ("EPLRef1", rf".*\b(?:eclipse public license|epl){_VER % 1}.*"),
    ("EUPLRef12", rf".*\b(?:european union public licen[cs]e|eupl){_VER % '1.2'}.*"),
    ("CDDLRef1", rf".*\b(?:common development and distribution license|cddl)(?: \(cddl\))?{_VER % 1}.*"),
    ("ArtisticRef2", rf".*\bartistic license{_VER % 2}.*"),
    ("BoostRef1", rf".*\bboost software license{_VER % 1}.*"),
    ("OFLRef11", rf".*\bsil open font license{_VER % '1.1'}.*"),
    ("PSFRef2", rf".*\b(?:psf|python software foundation) license(?: agreement)?{_VER % 2}.*"),
    ("ZlibRef", r".*\bunder (?:the )?(?:terms of )?(?:the )?zlib license.*"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose, including commercial applications.*"),
    ("ZlibOrigin", r"(?:\d[.)] )?the origin of this software must not be misrepresented.*"),
    ("WTFPLRef", r".*\b(?:do what the fuck you want to public license|wtfpl)\b.*"),
    ("CC0Ref", r".*\b(?:cc0|creative commons zero)\b.*"),
    ("PublicDomain", r".*\b(?:released|placed|dedicated) (?:in)?to the public domain.*|this is free and unencumbered software released into the public domain.*"),
    ("AllRights", r"(?:.*\b)?all rights reserved\.?"),
    ("Copyright", r"(?:copyright|\(c\)|©).*\d{4}.*|copyright .*"),
]


def _inside(name: str, pattern: str) -> tuple[str, re.Pattern, str]:
    """Name, a pattern to search within a sentence, and a text that every match ends with ('' if there is none):
    up to its last place, a search with a gap ends at the nearest one, so that it reads the sentence once.
    Words end at ASCII letters only: other scripts are written on without a space."""
    ends = {"AsIs": " as is", "BSDNoEndorse": " may be used to endorse"}
    if name == "MITNotice":  # what stands before the words is not needed to find them
        pattern = pattern.replace("(?:the above copyright notice and this permission notice .*)?", "")
    for start in (".*", r"(?:.*\W)?", r"(?:.*\b)?"):
        pattern = pattern.removeprefix(start)
    pattern = re.sub(r"\.\*(?=$|\|)", "", pattern).replace(".*", ".*?")
    return name, re.compile(rf"(?<!\w)(?:{pattern})", re.A), ends.get(name, "")


#: Titles of licences, which are known only where they are a whole sentence.
TITLES = [
    (name, re.compile(pattern + r"[.:]?", re.A))
    for name, pattern in (
        ("ApacheRef2", r"(?:the )?apache(?: software)? license,? ?(?:version |v\.? ?)?2(?:\.0)?"),
        ("ApacheTitle", r"(?:the )?apache license"),
        ("ApacheDate", r"version 2\.0, january 2004"),
        ("MITRef", r"(?:the )?mit license(?: \(mit\))?"),
        ("ISCRef", r"(?:the )?isc license(?: \(iscl?\))?"),
        ("BSDRef3", r"(?:the )?(?:bsd 3-clause|3-clause bsd|new bsd|modified bsd)(?: license)?"),
        ("BSDRef2", r"(?:the )?(?:bsd 2-clause|2-clause bsd|simplified bsd)(?: license)?"),
        ("BSDRef", r"(?:the )?bsd license"),
        ("UnlicenseRef", r"(?:the )?unlicense"),
        ("ZlibRef", r"(?:the )?zlib license"),
        ("GPL2Date", r"version 2, june 1991"),
        ("GPL3Date", r"version 3, 29 june 2007"),
        ("AGPL3Date", r"version 3, 19 november 2007"),
    )
]
KNOWN = [_inside(name, pattern) for name, pattern in SENTENCES if name != "Copyright"]
#: Begins a sentence, and says the least: only where nothing else is known in it.
COPYRIGHT = re.compile(dict(SENTENCES)["Copyright"])

#: Licence, then the sentence identifiers that make it, in order: other sentences may stand between.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDNoEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("MIT", ("MITGrant", "MITNotice", "AsIs")),
    ("MIT", ("MITGrant", "MITNotice")),
    ("ISC", ("ISCGrant", "AsIs")),
    ("ISC", ("ISCGrant",)),
    ("Zlib", ("ZlibGrant", "ZlibOrigin")),
    ("Apache-2.0", ("ApacheTitle", "ApacheDate")),
    ("AGPL-3.0", ("AGPLRef", "AGPL3Date")),
    ("LGPL-3.0", ("LGPLRef", "GPL3Date")),
    ("GPL-3.0", ("GPLRef", "GPL3Date")),
    ("GPL-2.0", ("GPLRef", "GPL2Date")),
    ("AGPL-3.0-or-later", ("AGPLRef", "Version3Plus")),
    ("LGPL-3.0-or-later", ("LGPLRef", "Version3Plus")),
    ("LGPL-2.1-or-later", ("LGPLRef", "Version21Plus")),
    ("LGPL-2.0-or-later", ("LGPLRef", "Version2Plus")),
    ("GPL-3.0-or-later", ("GPLRef", "Version3Plus")),
    ("GPL-2.0-or-later", ("GPLRef", "Version2Plus")),
    *(
        (licence, (name,))
        for name, licence in {
            "ApacheRef2": "Apache-2.0", "ApacheRef11": "Apache-1.1", "ApacheRef1": "Apache-1.0", "ISCRef": "ISC", "UnlicenseRef": "Unlicense", "AGPLRef3Plus": "AGPL-3.0-or-later", "AGPLRef3": "AGPL-3.0", "LGPLRef3Plus": "LGPL-3.0-or-later", "LGPLRef3": "LGPL-3.0", "LGPLRef21Plus": "LGPL-2.1-or-later", "LGPLRef21": "LGPL-2.1",
            "GPLRef3Plus": "GPL-3.0-or-later", "GPLRef2Plus": "GPL-2.0-or-later", "GPLRef3": "GPL-3.0", "GPLRef2": "GPL-2.0", "MITRef": "MIT", "BSDRef3": "BSD-3-Clause", "BSDRef2": "BSD-2-Clause", "BSDRef": "BSD",
            "MPLRef2": "MPL-2.0", "EPLRef2": "EPL-2.0", "EPLRef1": "EPL-1.0", "EUPLRef12": "EUPL-1.2", "CDDLRef1": "CDDL-1.0", "ArtisticRef2": "Artistic-2.0", "BoostRef1": "BSL-1.0", "OFLRef11": "OFL-1.1", "PSFRef2": "PSF-2.0",
            "ZlibRef": "Zlib", "WTFPLRef": "WTFPL", "CC0Ref": "CC0-1.0", "PublicDomain": "PublicDomain", "AllRights": "AllRightsReserved",
        }.items()
    ),
]
#: Known sentences that need no rule: they say nothing of a licence on their own.
BESIDE = frozenset(("Copyright", "AsIs"))
_CC = {"attribution": "by", "noncommercial": "nc", "noderivs": "nd", "noderivatives": "nd", "sharealike": "sa"}


def normalised(sentence: str) -> str:
    """Without comment marks and quotes, white space made one space."""
    start = m.end() if (m := LEADING.match(sentence)) else 0
    end = len(sentence)
    while end > start and (sentence[end - 1].isspace() or sentence[end - 1] in TRAILING):
        end -= 1
    return " ".join(sentence[start:end].translate(QUOTES).split())


def expression(spdx: str) -> list[str]:
    """The licences of an SPDX expression in order, each with its exception; it ends before an operator in small letters."""
    out, words = [], re.findall(r"[\w.+-]+", spdx, re.A)
    with_next = False
    for word in words:
        if word in ("and", "or", "with"):
            break
        if word == "WITH" and out:
            with_next = True
        elif with_next:
            out[-1], with_next = f"{out[-1]} WITH {word}", False
        elif word not in ("AND", "OR", "WITH"):
            out.append(word)
    return out


def known(sentence: str) -> list[str]:
    """Identifiers of the known sentences in a normalised one, in order. Where two overlap, the one tried first counts."""
    plain = sentence.lower()
    taken: list[tuple[int, int, list[str]]] = []
    for name, pattern, ends in KNOWN:
        until = plain.rfind(ends) + len(ends) if ends in plain else 0
        for m in pattern.finditer(plain, 0, until if ends else len(plain)):
            at = bisect_left(taken, (m.start(),))
            if at and taken[at - 1][1] > m.start() or at < len(taken) and taken[at][0] < m.end():
                continue
            found = [name]
            if name == "CCRef":
                kind = "-".join(_CC.get(x, x) for x in m["name"].split("-"))
                found = [f"CC:CC-{kind.upper()}" + (f"-{m['version']}" if m["version"] else "")]
            elif name == "SPDX":  # as it is spelt, where lower case has kept the places
                spelt = sentence[m.start("name") : m.end("name")] if len(sentence) == len(plain) else re.sub(r" (and|or|with) ", lambda x: x[0].upper(), m["name"])
                found = [f"SPDX:{x}" for x in expression(spelt)]
            taken.insert(at, (m.start(), m.end(), found))
    if not taken:
        title = next((name for name, pattern in TITLES if pattern.fullmatch(plain)), "Copyright" if COPYRIGHT.fullmatch(plain) else None)
        return [title] if title else []
    return [x for _, _, found in taken for x in found]


def identify(text: str | None) -> list[tuple[str, int, int]]:
    """Identifiers and span of every licence sentence; UNKNOWN where a sentence speaks of a licence but isn't known."""
    out = []
    if not text or not TRIGGER.search(text):
        return out
    at = 0
    for m in [*BOUNDARY.finditer(text), None]:
        end = m.start() if m else len(text)
        sentence = text[at:end]
        if TRIGGER.search(sentence):
            plain = normalised(sentence)
            names = known(plain)
            if not names and re.search(r"licen[cs]ed? |licen[cs]e\b", plain, re.I):
                names = ["UNKNOWN"]
            out += [(name, at, end) for name in names]
        at = m.end() if m else end
    return out


def matched(identifiers: list[str]) -> tuple[list[str], bool]:
    """Licences of a sequence of identifiers, in the order of their first sentence, each once; and whether one that
    speaks of a licence is left that no rule used.

    Of each identifier the places are kept, and a rule moves on in them only: a text is read once for each rule that
    has all its identifiers.
    """
    found: list[tuple[int, str]] = []
    places: dict[str, list[int]] = {}
    for i, name in enumerate(identifiers):
        kind, _, licence = name.partition(":")
        if licence and kind in ("SPDX", "CC"):
            found.append((i, licence))
        else:
            places.setdefault(name, []).append(i)
    for licence, rule in RULES:
        if not all(places.get(name) for name in rule):
            continue
        at, used = [0] * len(rule), []
        while True:
            before = -1
            for j, name in enumerate(rule):
                while at[j] < len(places[name]) and places[name][at[j]] <= before:
                    at[j] += 1
                if at[j] == len(places[name]):
                    break
                before = places[name][at[j]]
            else:
                used.append([places[name][k] for name, k in zip(rule, at, strict=True)])
                at = [k + 1 for k in at]
                continue
            break
        found += [(x[0], licence) for x in used]
        for name, taken in zip(rule, map(set, zip(*used, strict=True)), strict=False):
            places[name] = [i for i in places[name] if i not in taken]
    left = any(where for name, where in places.items() if name not in BESIDE)
    return list(dict.fromkeys(x for _, x in sorted(found))), left


def licences(identifiers: list[str]) -> list[str]:
    return matched(identifiers)[0]


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with licences (array), sentences (array of id, begin, end) and unknown, in place of columns of those names.

    unknown: a sentence speaks of a licence and isn't known, or is known but no rule used it; copyright lines and
    disclaimers don't count. Null and empty texts, and texts without such sentences, have empty arrays and unknown
    false. A long text is read whole, in time that grows with its length; repeated rows get the same result each, null
    ids and other columns pass through, and an empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    own = ("licences", "sentences", "unknown")
    kept = [c for c in documents.columns if c not in own]
    added = "licences array<string>, sentences array<struct<id:string,begin:int,end:int>>, unknown boolean"
    spark = documents.sparkSession
    types = spark.createDataFrame([], added).schema
    schema = documents.select(*kept).schema
    for field in types.fields:
        schema = schema.add(field)
    sentence = pa.struct([("id", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            found = [identify(t) for t in batch[text].to_pylist()]
            both = [matched([x[0] for x in f]) for f in found]
            arrays = [pa.array([x for x, _ in both], pa.list_(pa.string())), pa.array([[{"id": a, "begin": b, "end": c} for a, b, c in f] for f in found], pa.list_(sentence)), pa.array([x for _, x in both], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *arrays], names=[*kept, *own])

    return documents.select(*kept).mapInArrow(run, schema)


def op3_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Scans every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "licences", F.transform("sentences", lambda s: s["id"]).alias("sentence_ids"), F.size("sentences").cast("long").alias("n_sentences"), "unknown")

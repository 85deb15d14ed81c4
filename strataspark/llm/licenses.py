"""Licence scan: canonical digest lookup of entire texts, in DataFrame functions only."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings that licence-matching guidelines treat as equal; the second form is kept.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# (identifier, whole text of a notice); the texts of whole licences are files of the folder ``licences``
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
]

# Titles that stand over a licence text or are left out.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License"],
    "ISC": ["ISC License", "The ISC License"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License"],
}
TERMS_END = "END OF TERMS AND CONDITIONS"  # what follows is advice on use, and is often left out


def licence_texts(folder: Path = Path(__file__).parent / "licences") -> list[tuple[str, str]]:
    """The texts of a folder of licences, with the forms that they are passed on in: with a title, without the advice at the end."""
    out = []
    for path in sorted(folder.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        forms = [text, *[f"{t}\n{text}" for t in TITLES.get(name, [])]]
        if TERMS_END in text:
            forms += [text[: text.index(TERMS_END)], text[: text.index(TERMS_END) + len(TERMS_END)]]
        out += [(name, t) for t in forms]
    return out


# A line that begins so is dropped, unless it is running text of a licence that happens to begin a line with the word.
COPYRIGHT_LINE = "^(portions )?copyright( |$)|^(portions )?c [0-9]{4}|^all rights reserved$"
RUNNING_LINE = "^copyright (notices?|holders?|owners?|laws?|licenses?|licences?|statements?|disclaimers?|interests?|treaty|treaties|protection|permission|status|ownership|infringement|and|or|in|is|on|to|as|for|if|that|under|this)( |$)"
# The mark of a list item, which differs between copies (1. or a) or a star), but for (c).
LIST_MARK = r"^[ \t]*(?:[0-9]{1,2}[.)]|[a-z][.)]|\((?:[0-9]{1,2}|[abd-z])\))[ \t]+"


def canonical(text: str) -> list[str]:
    """Canonical lines of one text, as the column form below makes them; used for the catalogue."""
    bare = re.sub(f"(?m){LIST_MARK}", "", text.replace("©", "(c)").lower())
    flat = re.sub(r"[^a-z0-9\n]+", " ", bare)
    out = []
    for line in (x.strip(" ") for x in flat.split("\n")):
        if line and not (re.search(COPYRIGHT_LINE, line) and not re.search(RUNNING_LINE, line)):
            for a, b in EQUIVALENT:
                line = re.sub(rf"\b{a}\b", b, line)
            out.append(line)
    return out


def catalogue_digests(catalogue=None) -> list[tuple[str, str, int]]:
    """(digest, licence id, length) of every known text; the first of equal digests is kept."""
    found: dict[str, tuple[str, int]] = {}
    for name, text in NOTICES + licence_texts() if catalogue is None else catalogue:
        whole = " ".join(canonical(text or ""))
        if whole:
            found.setdefault(hashlib.sha256(whole.encode()).hexdigest(), (name, len(whole)))
    return [(d, n, k) for d, (n, k) in found.items()]


def canonical_lines(text):
    """Column of canonical lines: case, punctuation, copyright lines and spellings made equal."""
    bare = F.regexp_replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("©"), F.lit("(c)"))), f"(?md){LIST_MARK}", "")
    flat = F.regexp_replace(bare, "[^a-z0-9\n]+", " ")
    lines = F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~(x.rlike(COPYRIGHT_LINE) & ~x.rlike(RUNNING_LINE)))

    def spelled(x):
        for a, b in EQUIVALENT:
            x = F.regexp_replace(x, rf"\b{a}\b", b)
        return x

    variant = r"\b(" + "|".join(a for a, _ in EQUIVALENT) + r")\b"
    return F.when(flat.rlike(variant), F.transform(lines, spelled)).otherwise(lines)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalogue=None) -> DataFrame:
    """One row per input row: ``doc_id, text_digest, license_id, n_notices, notice_ids``.

    ``text_digest`` is the SHA-256 of the canonical whole text and ``license_id``
    the known licence with that digest, else null. A line is an entire text of
    its own too: ``n_notices`` counts the lines whose digest is known, and
    ``notice_ids`` has their distinct ids, sorted and comma-joined (null if none).
    Null and empty texts have the digest of the empty text and match nothing;
    repeated rows are answered row by row; other columns are not looked at.

    Case, punctuation, list marks, line breaks, copyright lines and equivalent spellings do not matter. The catalogue has the
    texts in the folder ``licences`` (with and without titles and the advice behind their terms) and short notices, or
    is the caller's list of ``(id, text)``. Its size does not follow the data:
    the whole texts meet it in a broadcast hash join on the digest and the few
    lines of a fitting length in a literal map, so that nothing is shuffled.
    """
    known = catalogue_digests(catalogue)
    lengths = sorted({k for _, _, k in known}) or [-1]
    table = F.create_map(*[F.lit(x) for d, n, _ in known for x in (d, n)]) if known else F.create_map(F.lit(""), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    digested = lines.select(
        "doc_id",
        F.array_join("lines", " ").alias("whole"),
        F.transform(F.filter("lines", lambda x: F.length(x).isin(lengths)), lambda x: F.sha2(x, 256)).alias("notices"),
    ).select("doc_id", F.sha2("whole", 256).alias("text_digest"), "notices")
    rows = F.array(*[F.struct(F.lit(d).alias("text_digest"), F.lit(n).alias("license_id")) for d, n, _ in known or [("", "", 0)]])
    catalogue_df = docs.sparkSession.range(1).select(F.inline(rows))
    hits = F.filter(F.transform("notices", lambda x: F.element_at(table, x)), lambda x: x.isNotNull())
    return digested.join(F.broadcast(catalogue_df), "text_digest", "left").select(
        "doc_id",
        "text_digest",
        "license_id",
        F.size(hits).cast("long").alias("n_notices"),
        F.when(F.size(hits) > 0, F.array_join(F.array_sort(F.array_distinct(hits)), ",")).alias("notice_ids"),
    )


def license_sql() -> str:
    """The same scan in DuckDB SQL."""
    known = ", ".join(f"('{d}', '{n}')" for d, n, _ in catalogue_digests())
    line = "x"
    for a, b in EQUIVALENT:
        line = rf"regexp_replace({line}, '\b{a}\b', '{b}', 'g')"
    return rf"""
WITH known(digest, license_id) AS (VALUES {known}),
flat AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(lower(replace(coalesce(text, ''), '©', '(c)')), '(?m){LIST_MARK}', '', 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS raw FROM documents),
kept AS (SELECT doc_id, list_filter(list_transform(raw, lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT (regexp_matches(x, '{COPYRIGHT_LINE}') AND NOT regexp_matches(x, '{RUNNING_LINE}'))) AS ls FROM flat),
lines AS (SELECT doc_id, list_transform(ls, lambda x: {line}) AS ls FROM kept),
whole AS (SELECT doc_id, sha256(coalesce(array_to_string(ls, ' '), '')) AS text_digest FROM lines),
notice AS (
  SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notice_ids
  FROM (SELECT doc_id, sha256(unnest(ls)) AS digest FROM lines) n JOIN known k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(n.n_notices, 0)::BIGINT AS n_notices, n.notice_ids
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN notice n ON n.doc_id = w.doc_id
"""

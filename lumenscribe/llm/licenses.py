"""License scans: Dice coefficient over word bigrams against licence templates.

Units of a text are normalised to lower-case words without punctuation and compared, as
sets of word bigrams, with every template whose size allows the threshold: Dice(A, B) >= t
needs t / (2 - t) <= |A| / |B| <= (2 - t) / t. Units are

* lines, paragraphs (blocks between blank lines, of more than one line) and whole
  documents (of more than one paragraph), compared with all templates;
* passages, for licences inside longer texts, whatever stands before, after or between
  their lines: a line begins a passage of a template if at least half of its bigrams are
  the template's and those of the line before aren't (lines of fewer than two words don't
  count). A passage ends with the last line up to which it has at most as many words as the
  template, or with the first up to which it has at least as many; both are compared, with
  that template only, if they have more than one line.

Templates are the notices and lines below and the whole terms in ``license_texts``; an id
followed by "-header" or "-line" is a notice that points to the licence.

Defined cases: a null or empty text, and a unit of one word, matches nothing; the best
template of a unit (of a passage: of all that begin at its line) is reported, the first
name on ties; repeated rows are reported each; an empty table gives an empty result;
columns other than the key and the text are not read. Keys may be of any type.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.llm.common import arrow_map, col, typed
from lumenscribe.llm.kernels import WORD_RE, Texts, Words, distinct

THRESHOLD_PPM = 800_000
_GNU = 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>.'
TEMPLATES = {path.stem: path.read_text(encoding="utf-8") for path in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))} | {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-header": _GNU.format("General Public License", 2),
    "gpl-3.0-header": _GNU.format("General Public License", 3),
    "lgpl-3.0-header": _GNU.format("Lesser General Public License", 3),
    "agpl-3.0-header": _GNU.format("Affero General Public License", 3),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-header": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-4.0-header": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


class TemplateIndex:
    """Bigram hashes of all templates: bigram -> templates, and their sizes."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        texts = Texts(pa.array([templates[n].lower() for n in self.names]))
        sets = [distinct(texts.words(k, k + 1).windows(2)) for k in range(len(texts))]
        self.sizes = np.array([len(s) for s in sets])
        self.sets, self.words = sets, np.array([texts.words(k, k + 1).counts[0] for k in range(len(texts))])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, flat))
        self.bigrams, first = np.unique(flat[order], return_index=True)
        self.owner, self.first = owner[order], np.append(first, len(order))


def _groups(words: Words, doc: np.ndarray, offsets: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, unit of each word, line number of each word)."""
    data, starts = words.data, words.starts
    breaks = np.flatnonzero(data == 10)
    seen = np.searchsorted(breaks, starts)
    line_no = seen - np.searchsorted(breaks, offsets[doc])
    ink = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data != 32) & ((data < 9) | (data > 13)), out=ink[1:], dtype=np.int32)
    begin = np.maximum(np.append(0, breaks[:-1] + 1)[: len(breaks)], offsets[np.searchsorted(offsets, breaks, "right") - 1])
    blanks = np.append(0, np.cumsum(ink[breaks] == ink[begin]))[seen]
    number = lambda *keys: np.append(0, np.cumsum(np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    line, para = number(doc, seen), number(doc, blanks)
    return [("line", line, line_no), ("paragraph", para, line), ("document", number(doc), para)]


def _passages(index: TemplateIndex, ppm: int, doc: np.ndarray, line: np.ndarray, pairs: np.ndarray, at: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, dice, template) of the passages over the threshold; line: a number for each word."""
    inside = np.flatnonzero(line[1:] == line[:-1])  # bigrams within a line
    if not hit[inside].any():
        return []
    order = inside[np.lexsort((pairs[inside], line[inside]))]
    order = order[np.append(True, (line[order[1:]] != line[order[:-1]]) | (pairs[order[1:]] != pairs[order[:-1]]))]
    size = np.bincount(line[order], minlength=line[-1] + 1)
    number = np.cumsum(size > 0) - 1  # lines of two words or more, in turn
    known, t = order[hit[order]], np.int64(len(index.names))
    n = index.first[at[known] + 1] - index.first[at[known]]
    owner = index.owner[np.repeat(index.first[at[known]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    keys = np.sort(np.repeat(line[known], n) * t + owner)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, m = keys[first], np.diff(np.append(first, len(keys)))
    keys = keys[2 * m >= size[keys // t]]
    # those whose line before, of the same document, has the template too begin nothing
    begins = np.searchsorted(line, np.arange(line[-1] + 1))
    stops = np.append(begins[1:], len(line))
    lines, names = keys // t, keys % t
    before = (number[lines] - 1) * t + names
    has = np.isin(before, number[lines] * t + names) & (number[lines] > 0)
    wordy = np.flatnonzero(size > 0)
    has &= doc[begins[wordy[np.maximum(number[lines] - 1, 0)]]] == doc[begins[lines]]
    hits, ends, out = np.append(0, np.cumsum(hit)), np.searchsorted(doc, np.arange(doc[-1] + 1), "right"), []
    for k in np.flatnonzero(~has):
        name, a = int(names[k]), int(begins[lines[k]])
        end, want = int(ends[doc[a]]), a + int(index.words[name])
        last = int(np.searchsorted(stops, want, "right")) - 1
        for stop in {int(stops[last]) if last >= 0 else 0, int(stops[min(np.searchsorted(stops, want), len(stops) - 1)])}:
            stop = min(stop, end)
            if stop <= stops[lines[k]] or (hits[stop - 1] - hits[a]) * (2e6 - ppm) < index.sizes[name] * ppm:
                continue
            own = distinct(pairs[a : stop - 1])
            dice = 2_000_000 * int(np.isin(own, index.sets[name]).sum()) // (len(own) + int(index.sizes[name]))
            if dice >= ppm:
                out.append((a, dice, name))
    return out


def _scan(batch: pa.RecordBatch, index: TemplateIndex, ppm: int) -> pa.RecordBatch:
    texts, found = Texts(batch.column(1)), []
    least, most = index.sizes.min() * ppm / (2e6 - ppm), index.sizes.max() * (2e6 - ppm) / ppm
    for lo, hi in texts.slices():
        words = texts.words(lo, hi)
        if len(words.hashes) < 2:
            continue
        offsets = texts.offsets[lo : hi + 1] - texts.offsets[lo]
        doc, pairs = np.repeat(np.arange(hi - lo), words.counts), words.windows(2)
        at = np.minimum(np.searchsorted(index.bigrams, pairs), len(index.bigrams) - 1)
        hit = index.bigrams[at] == pairs
        if not hit.any():
            continue
        units = _groups(words, doc, offsets)
        best: dict[int, tuple[int, int]] = {}
        for word, dice, t in _passages(index, ppm, doc, units[0][1], pairs, at, hit):
            best[word] = min(best.get(word, (0, 0)), (-dice, t))
        found += [("passage", lo, word, lo + doc[word], int(units[0][2][word]), index.names[t], -dice) for word, (dice, t) in best.items()]
        for kind, unit, inner in units:
            inside = unit[1:] == unit[:-1]
            hits = np.bincount(unit[1:][inside & hit], minlength=unit[-1] + 1)
            first = np.searchsorted(unit, np.arange(unit[-1] + 1))
            last = np.append(first[1:], len(unit)) - 1
            likely = hits >= max(1, int(least / 2))
            if kind != "line":
                likely &= inner[first] != inner[last]
            chosen = np.flatnonzero(inside & likely[unit[1:]])
            if not len(chosen):
                continue
            order = chosen[np.lexsort((pairs[chosen], unit[chosen]))]
            fresh = np.append(True, (unit[order[1:]] != unit[order[:-1]]) | (pairs[order[1:]] != pairs[order[:-1]]))
            order = order[fresh]
            size = np.bincount(unit[order], minlength=unit[-1] + 1)
            common = order[hit[order] & (size[unit[order]] >= least) & (size[unit[order]] <= most)]
            n = index.first[at[common] + 1] - index.first[at[common]]
            owner = index.owner[np.repeat(index.first[at[common]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            keys, m = np.unique(np.repeat(unit[common], n) * len(index.names) + owner, return_counts=True)
            u, t = keys // len(index.names), keys % len(index.names)
            dice = 2_000_000 * m // (size[u] + index.sizes[t])
            for k in np.lexsort((t, -dice, u)):
                if dice[k] >= ppm and (not found or found[-1][:3] != (kind, lo, u[k])):
                    word = first[u[k]]
                    found.append((kind, lo, u[k], lo + doc[word], int(units[0][2][word]), index.names[t[k]], int(dice[k])))
    ids = batch.column(0).take(pa.array([f[3] for f in found], pa.int64()))
    columns = [pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.string()), (4, pa.int32()), (5, pa.string()), (6, pa.int32()))]
    return pa.record_batch([ids, *columns], names=["doc_id", "unit", "line", "license", "dice_ppm"])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold_ppm: int = THRESHOLD_PPM) -> DataFrame:
    """doc_id, unit, line (of the unit's first word), license, dice_ppm. No shuffle."""
    index = TemplateIndex(templates)
    narrow = docs.select(col(key).alias("doc_id"), F.lower(col(text)).alias("text"))
    return arrow_map(narrow, lambda batch: _scan(batch, index, threshold_ppm), typed(narrow, doc_id="doc_id") + "unit string, line int, license string, dice_ppm int")


_RE = r"[^\x00-/:-@\[-`{-\x7f]+"
_ROWS = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
SQL = f"""
with
tpl as (
  select name, len(w) as n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bigrams
  from (select name, regexp_extract_all(lower(body), '{_RE}') as w from (values {_ROWS}) v(name, body))),
rows_of as (select row_number() over () as rid, doc_id, string_split(lower(text), chr(10)) as parts from documents where text is not null),
lines as (
  select rid, doc_id, i - 1 as line, regexp_extract_all(parts[i], '{_RE}') as w, regexp_full_match(parts[i], '[ \\t\\r\\f\\x0b]*') as blank
  from (select rid, doc_id, parts, unnest(range(1, len(parts) + 1)) as i from rows_of)),
placed as (select *, coalesce(sum(blank::int) over (partition by rid order by line rows between unbounded preceding and 1 preceding), 0) as para from lines),
inked as (select * from placed where len(w) > 0),
units as (
  select rid, doc_id, 'line' as unit, line, w from inked
  union all
  select rid, doc_id, 'paragraph', min(line), flatten(list(w order by line)) from inked group by rid, doc_id, para having count(*) > 1
  union all
  select rid, doc_id, 'document', min(line), flatten(list(w order by line)) from inked group by rid, doc_id having count(distinct para) > 1),
sets as (
  select rid, doc_id, unit, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bigrams from units where len(w) > 1),
scored as (
  select rid, doc_id, unit, line, name, 2000000 * len(list_intersect(s.bigrams, t.bigrams)) // (len(s.bigrams) + len(t.bigrams)) as dice
  from sets s join tpl t on len(s.bigrams) * (2000000 - {THRESHOLD_PPM}) >= len(t.bigrams) * {THRESHOLD_PPM} and len(t.bigrams) * (2000000 - {THRESHOLD_PPM}) >= len(s.bigrams) * {THRESHOLD_PPM}),
wordy as (
  select rid, line, row_number() over (partition by rid order by line) as k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bigrams
  from inked where len(w) > 1),
tpl_grams as (select name, unnest(bigrams) as gram from tpl),
line_hits as (select rid, line, name, count(*) as m from (select rid, line, unnest(bigrams) as gram from wordy) join tpl_grams using (gram) group by all),
likely as (select rid, line, k, name from line_hits join wordy using (rid, line) where 2 * m >= len(bigrams)),
begins as (select l.rid, l.line, l.name from likely l anti join likely p on p.rid = l.rid and p.name = l.name and p.k = l.k - 1),
upto as (select rid, doc_id, line, sum(len(w)) over (partition by rid order by line) as words, len(w) as own from inked),
goals as (select b.rid, b.line, b.name, u.words - u.own as since, n from begins b join upto u using (rid, line) join tpl using (name)),
stops as (
  select g.rid, g.line, g.name, max(case when u.words - since <= n then u.line end) as short, coalesce(min(case when u.words - since >= n then u.line end), max(u.line)) as long
  from goals g join upto u on u.rid = g.rid and u.line >= g.line group by all),
passages as (
  select p.rid, i.doc_id, p.line, p.name, p.stop, flatten(list(i.w order by i.line)) as w
  from (select rid, line, name, short as stop from stops where short > line union select rid, line, name, long from stops where long > line) p
  join inked i on i.rid = p.rid and i.line between p.line and p.stop group by all),
passage_sets as (select rid, doc_id, line, name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as own from passages),
all_scored as (
  select * from scored
  union all
  select rid, doc_id, 'passage', line, name, 2000000 * len(list_intersect(own, bigrams)) // (len(own) + len(bigrams)) from passage_sets join tpl using (name)),
best as (select *, row_number() over (partition by rid, unit, line order by dice desc, name) as place from all_scored where dice >= {THRESHOLD_PPM})
select doc_id, unit, line::int as line, name as license, dice::int as dice_ppm from best where place = 1
"""


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

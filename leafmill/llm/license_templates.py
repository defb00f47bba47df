"""License scans by template markup: optional and replaceable regions compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import alnum_words, bounded_batches, task, text_bytes

#: Phrases that the standard query counts, and their labels.
OP10_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices and texts in template markup. [[ ]] may be left out and may hold other regions; {{n}} stands for up to n words
#: of any kind; the rest must match word for word, whatever stands between the words.
TEMPLATES = {
    "gpl-3.0-notice": "licensed under[[ the terms of]] the GNU General Public License[[ as published by the Free Software Foundation]][[ either]] version 3[[ of the License[[ or at your option any later version]]]]",
    "gpl-2.0-notice": "licensed under[[ the terms of]] the GNU General Public License[[ as published by the Free Software Foundation]][[ either]] version 2[[ of the License[[ or at your option any later version]]]]",
    "gpl-header": "[[{{8}} is free software ]]you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[[ either]] version {{1}}[[ of the License]][[ or at your option any later version]]",
    "apache-2.0-notice": "licensed under the Apache License[[ the License]] version 2 0",
    "apache-2.0-header": "licensed under the Apache License version 2 0 the License you may not use this file except in compliance with the License you may obtain a copy of the License at {{12}}[[ unless required by applicable law or agreed to in writing software distributed under the License is distributed on an as is basis without warranties or conditions of any kind either express or implied see the License for the specific language governing permissions and limitations under the License]]",
    "mit-notice": "[[released]][[licensed]] under the[[ terms of the]] MIT License",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this {{4}} and associated documentation files[[ the {{2}} to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute[[ sublicense]] and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice[[ including the next paragraph]] shall be included in all copies or substantial portions of the software[[ the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]]]]",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met[[ 1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer[[ 2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution[[[[ 3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]]",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "isc-text": "permission to use copy modify and[[ or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-4.0-notice": "licensed under[[ the]][[ Creative Commons[[ Attribution]]]] CC BY 4 0[[ international[[ license]]]]",
    "cc-by-nc-4.0-notice": "licensed under[[ the]][[ Creative Commons[[ Attribution NonCommercial]]]] CC BY NC 4 0[[ international[[ license]]]]",
    "spdx-tag": "SPDX License Identifier {{3}}",
    "all-rights-reserved": "copyright[[ c]] {{6}} all rights reserved",
}


@dataclass
class Template:
    """A token automaton: `moves[s]` by word, `any[s]` for a replaceable word, `skips[s]` without a word."""

    label: str
    moves: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: list[int | None] = field(default_factory=lambda: [None])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0

    def add(self) -> int:
        self.moves.append({})
        self.any.append(None)
        self.skips.append([])
        return len(self.moves) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def starts(self) -> set[bytes]:
        """The words a match can begin with; templates begin with fixed wording or an optional region."""
        return {w for s in self.closed({0}) for w in self.moves[s]}

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest match of the whole template that begins at `at`, or -1."""
        states, best = self.closed({0}), -1
        for i in range(at, len(words)):
            word, after = words[i], set()
            for s in states:
                if (t := self.moves[s].get(word)) is not None:
                    after.add(t)
                if (t := self.any[s]) is not None:
                    after.add(t)
            if not after:
                break
            states = self.closed(after)
            if self.final in states:
                best = i + 1
        return best


def compile_template(label: str, markup: str) -> Template:
    """Reads [[optional]] regions, which may nest, and {{n}} regions; other double brackets are an error."""
    out, at, opened = Template(label), 0, []

    def closing(begin: int, last: int) -> int:
        end = out.add()  # a state of its own, so that what follows cannot loop back
        out.skips[last].append(end)
        if begin != last:
            out.skips[begin].append(end)
        return end

    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\{\{|\}\}|(?:(?!\[\[|\]\]|\{\{|\}\}).)+", markup, re.DOTALL):
        if part == "[[":
            opened.append(at)
        elif part == "]]" and opened:
            at = closing(opened.pop(), at)
        elif part in ("]]", "{{", "}}"):
            raise ValueError(f"template {label}: {part} without its other end")
        elif part.startswith("{{"):
            begins = [at]
            for _ in range(int(part[2:-2])):
                out.any[at] = out.add()
                at = out.any[at]
                begins.append(at)
            end = out.add()
            for s in begins:
                out.skips[s].append(end)
            at = end
        else:
            for word in alnum_words(part.encode()):
                out.moves[at][word] = out.add()
                at = out.moves[at][word]
    if opened:
        raise ValueError(f"template {label}: [[ without its other end")
    out.final = at
    return out


def scan_licenses(docs: DataFrame, key: str, text: str, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """For each row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    `phrases` are places where words stand consecutively, whatever is around them; `templates` are
    accepted only where all of their mandatory wording matches. notices lists label, first word and end
    of each accepted template, longest first at a place. score is the share of the text's words that
    lie in a phrase or a notice. The tables of phrases and templates are code, not data, and go to every
    task. Null and empty texts have no words and score 0; repeated rows are scanned each; of templates that
    accept the same words all give their label; nothing is shuffled, a very long text takes one pass; an empty
    table gives no rows; columns other than key and text are not looked at.
    """
    plain = {tuple(alnum_words(p.encode())): label for p, label in phrases.items()}
    automata = [compile_template(label, markup) for label, markup in templates.items()]
    rare = {w[-1] for w in plain} | {w for a in automata for w in _least_common(a)}

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        by_first: dict[bytes, list] = {}
        for words in plain:
            by_first.setdefault(words[0], []).append(words)
        by_start: dict[bytes, list[Template]] = {}
        for a in automata:
            for w in a.starts():
                by_start.setdefault(w, []).append(a)
        either = by_first.keys() | by_start.keys()
        for batch in batches:
            rows = []
            for raw in text_bytes(batch.column(1)):
                words = alnum_words(raw)
                places, notices = [], []
                if not rare.isdisjoint(words):
                    for i in [i for i, w in enumerate(words) if w in either]:
                        for p in by_first.get(words[i], ()):
                            if tuple(words[i : i + len(p)]) == p:
                                places.append((i, i + len(p), plain[p]))
                        for a in by_start.get(words[i], ()):
                            if (end := a.match(words, i)) > 0:
                                notices.append((a.label, i, end))
                covered = set()
                for i, end in [(i, end) for i, end, _ in places] + [(i, end) for _, i, end in notices]:
                    covered.update(range(i, end))
                base = sorted({label for *_, label in places})
                starts = [i for i, *_ in places]
                rows.append({
                    "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(base),
                    "labels": ",".join(sorted({*base, *(n[0] for n in notices)})), "score": len(covered) / len(words) if words else 0.0,
                    "notices": [{"label": n[0], "first": n[1], "end": n[2]} for n in sorted(notices, key=lambda n: (n[1], -n[2], n[0]))],
                })
            found = pa.array(rows, type=_result())
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], names=[key, *[f.name for f in _result()]])

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first:long,end:long>>"
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(task(scan), schema)


def _result():
    import pyarrow as pa

    notice = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    return pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("notices", pa.list_(notice))])


def _least_common(a: Template) -> set[bytes]:
    """Words of which every match has one: the longest mandatory word of the template, found by leaving each out."""
    words = sorted({w for m in a.moves for w in m}, key=lambda w: (-len(w), w))
    for w in words:
        reach, todo = {0}, [0]
        while todo:
            s = todo.pop()
            for t in [*a.skips[s], *([] if a.any[s] is None else [a.any[s]]), *(t for v, t in a.moves[s].items() if v != w)]:
                if t not in reach:
                    reach.add(t)
                    todo.append(t)
        if a.final not in reach:
            return {w}
    raise ValueError(f"template {a.label} has no mandatory word")


def op10_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs, "doc_id", "text", OP10_PHRASES, TEMPLATES)

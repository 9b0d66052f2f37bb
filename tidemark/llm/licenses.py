"""License scans: a trained paragraph classifier names the licence family, templates confirm it."""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blobs

#: Notices that name a licence family, fixed values of the method.
NOTICES = {
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v2.0.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.", "Licensed under the GNU GPL version 2 or later.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "bsd": (
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Licensed under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "Released under the AGPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "epl": ("Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License, version 2.0"),
    "isc": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "unlicense": ("Released under the Unlicense.", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
}
#: What a notice of a family says of its name: a prediction is confirmed only where its family's name stands and no other
#: family's, or where a template of LONG words or more is alike. Fixed values.
NAMES = {
    "mit": r"\bmit licen[cs]e|licen[cs]e (?:identifier )?mit\b|\bmit terms", "apache": r"\bapache\b", "gpl": r"\bgnu general public|\bgnu gpl|\bgpl(?: ?v| ?\d| version|\b)", "lgpl": r"\blesser general public|\blgpl",
    "agpl": r"\baffero general public|\bagpl", "bsd": r"\bbsd\b", "mpl": r"\bmozilla public|\bmpl\b", "epl": r"\beclipse public|\bepl\b", "isc": r"\bisc licen[cs]e|identifier isc\b", "unlicense": r"\bunlicense",
    "cc-by": r"\bcc by (?!sa|nc|nd)|commons attribution (?!share|no)", "cc-by-sa": r"\bcc by sa|commons attribution share", "cc-by-nd": r"\bcc by nd|commons attribution no ?deriv",
    "cc-by-nc": r"\bcc by nc (?!sa|nd)|commons attribution non ?commercial (?!share|no)", "cc-by-nc-sa": r"\bcc by nc sa|commons attribution non ?commercial share",
    "cc-by-nc-nd": r"\bcc by nc nd|commons attribution non ?commercial no ?deriv", "cc0": r"\bcc0\b", "proprietary": r"\ball rights reserved|proprietary and confidential|unauthorized copying",
}
#: Ordinary sentences close to notices, for the unknown class: those it is trained on, and those its bias is set by.
OTHERS = (
    "He got his driving license last year.", "The general public was free to use the library.", "The terms of the agreement were published by the foundation.",
    "The software is distributed with a manual in two versions.", "Permission was granted by the office.", "He was released under the terms of the agreement.",
    "This work is under way and the project is large.", "Copyright law is discussed in the second part.", "The apache helicopter landed at the base.",
    "The students of MIT won the contest.", "All people have rights that the state reserved for them.", "A copy of the letter may be obtained from the school.",
    "Sie ging mit ihrem Hund in den Park und kam mit dem Bus zurück.", "Er spricht mit der Lehrerin, die mit uns nach Berlin fährt.", "Ils ont obtenu la permission de la ville.",
    "La licencia de conducir fue publicada por la oficina.", "Das Buch wurde mit vielen Bildern und mit einem Register gedruckt.",
    "A table was reserved for all the guests, and their rights were explained.", "Version 2 of the report was 4 pages shorter than version 3.", "The mozilla was a figure in the old story, and the eclipse was seen in public.",
)
PLAIN = (
    "The driver must carry a license and all rights are reserved by the club.", "Mit freundlichen Grüßen schrieb er mit der Hand.", "The public library has a copy of the general terms.",
    "She was granted permission to copy the software for the school.", "Die Frau wohnt mit zwei Kindern und mit ihrer Mutter in der Stadt.", "The common attribution of the work is wrong.",
    "Creative people work in the commons room under the roof.", "The institute released the results under pressure.", "A foundation for free education was founded in 1990.",
    "Wir fahren mit dem Zug, denn mit dem Auto dauert es länger.", "Le public est libre et la version 2 est gratuite.", "The source of the river is subject to the terms of the treaty.",
)
FAMILIES = (*NOTICES, "unknown")
#: A paragraph with more than this probability of the unknown class is none; share of a template's word pairs that confirms it.
SURE, ALIKE = 0.5, 0.6
#: Probability from which a family is compared with its templates besides the likeliest.
LIKELY = 0.05
#: Words of a template that confirms a family without its name.
LONG = 10
_WORD = re.compile(r"[a-z]+[a-z0-9]*|\d+")


def grams(words: list[str]) -> list[str]:
    return [*words, *map(" ".join, zip(words, words[1:], strict=False))]


class LicenseModel:
    """Multinomial logistic regression on the presence of word 1- and 2-grams (rare ones by class weights kept apart),
    trained on the notices, their fragments with other words around them, and ordinary sentences as unknown."""

    def __init__(self, epochs: int = 500, rate: float = 6.0, l2: float = 1e-5):
        texts, y = [], []
        filler = [w for o in OTHERS for w in _WORD.findall(o.lower())]
        turn = np.random.default_rng(7)
        for k, family in enumerate(FAMILIES):
            for notice in NOTICES.get(family, OTHERS):
                w = _WORD.findall(notice.lower())
                for v in range(6):
                    lead = [filler[i] for i in turn.integers(0, len(filler), v * 4)] if v else []
                    texts.append([*lead[: len(lead) // 2], *w, *lead[len(lead) // 2 :]])
                    y.append(k)
        for _ in range(200):
            texts.append([filler[i] for i in turn.integers(0, len(filler), int(turn.integers(0, 40)))])
            y.append(len(FAMILIES) - 1)
        self.index = {g: i for i, g in enumerate(sorted({g for t in texts for g in grams(t)}))}
        x = np.zeros((len(texts), len(self.index) + 1))
        for i, t in enumerate(texts):
            x[i] = self._vector(t)
        y = np.eye(len(FAMILIES))[y]
        self.w = np.zeros((x.shape[1], len(FAMILIES)))
        self.w[-1, -1] = 1.0  # without a known gram: unknown
        for _ in range(epochs):
            p = self._softmax(x @ self.w)
            self.w -= rate * (x.T @ (p - y) / len(x) + l2 * self.w)
        # calibration of the unknown class on sentences it was not trained on: its bias rises until none passes for a licence
        plain = np.stack([self._vector(_WORD.findall(o.lower())) for o in (*OTHERS, *PLAIN)])
        for _ in range(50):
            if (self._softmax(plain @ self.w)[:, -1] > SURE).all():
                break
            self.w[-1, -1] += 0.1
        self.pairs = {f: [(set(grams(w)), len(w)) for w in (_WORD.findall(t.lower()) for t in ts)] for f, ts in NOTICES.items()}
        self.names = {f: re.compile(p) for f, p in NAMES.items()}
        # what each gram and the bias can add at most to a family's score beyond that of the unknown class
        beyond = (self.w[:, :-1] - self.w[:, -1:]).max(axis=1)
        self.most, self.bias = {g: float(beyond[i]) for g, i in self.index.items()}, float(beyond[-1])

    def _vector(self, words: list[str]) -> np.ndarray:
        x = np.zeros(len(self.index) + 1)
        got = {self.index[g] for g in grams(words) if g in self.index}
        x[list(got)] = 1 / np.sqrt(max(1, len(got)))
        x[-1] = 1
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def hopeless(self, words: list[str]) -> bool:
        """Whether even together no families can reach the unknown class's probability."""
        got = [self.most[g] for g in {*grams(words)} if g in self.most]
        return sum(got) / max(1, len(got)) ** 0.5 + self.bias < -np.log(len(NOTICES)) - 1e-6

    def predict(self, paragraph: str) -> tuple[str, float, float, bool]:
        """(family, its probability, share of the best template's grams that the paragraph holds, whether that confirms it).

        Unknown is what the classifier finds likelier so than all families together. Of the families that it gives
        LIKELY or more, the likeliest confirmed one is taken, else the likeliest. A template confirms its family if ALIKE
        of its grams are there and the family's name stands and no other's; one of LONG words or more also without a name."""
        words = _WORD.findall(paragraph.lower())
        p = self._softmax(self._vector(words) @ self.w)
        if p[-1] > SURE:
            return "unknown", float(p[-1]), 0.0, False
        own, said = set(grams(words)), " ".join(words) + " "
        named = {f for f, name in self.names.items() if name.search(said)}
        rows = []
        for k in np.argsort(-p[:-1], kind="stable").tolist():
            if rows and p[k] < LIKELY:
                break
            family = FAMILIES[k]
            like, size = max((len(own & t) / len(t), n) for t, n in self.pairs[family])
            other = named - {family, "proprietary"}  # rights are reserved beside many a licence
            rows.append((family, float(p[k]), like, like >= ALIKE and not other and (family in named or size >= LONG)))
        return next((r for r in rows if r[3]), rows[0])

    def notices(self, lines: list[str]):
        """(number, family, probability, likeness, confirmed) of the lines and blocks of lines taken for notices."""
        start, known = 0, set()
        for no, line in enumerate([*lines, ""]):
            if line.strip():
                if self.hopeless(_WORD.findall(line.lower())):
                    continue
                family, p, like, sure = self.predict(line)
                if family != "unknown":
                    yield no, family, p, like, sure
                    if sure:
                        known.add(family)
                continue
            if no - start > 1:
                family, p, like, sure = self.predict(" ".join(lines[start:no]))
                if sure and family not in known:
                    yield start, family, p, like, sure
            start, known = no + 1, set()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per paragraph that is taken for a licence notice: doc_id, paragraph (number of its first line, from 0),
    family, probability, likeness, confirmed (see predict), text_hash. Unconfirmed rows are predictions only.

    Every line of every text is judged, and every block of lines between blank ones: a block gives a row if it is
    confirmed for a family that none of its lines is confirmed for. A bound from the trained weights spares only those
    whose score must be the unknown class's. Null and empty texts have no row; repeated rows are scanned each; rows
    without an id, or with one that others share, are told apart by text_hash; extra columns are ignored."""
    # as bytes that hold the class as well: workers need no copy of this package
    model = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(LicenseModel()))

    def run(batches):
        m = pickle.loads(model.value)
        for batch in batches:
            out = {k: [] for k in ("doc_id", "text_hash", "paragraph", "family", "probability", "likeness", "confirmed")}
            for *name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch, "text"), strict=True):
                for row in m.notices((text or b"").decode().split("\n")):
                    for k, v in zip(out, (*name, *row), strict=True):
                        out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, paragraph int, family string, probability double, likeness double, confirmed boolean")


def document_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, families (sorted, confirmed), n_notices (confirmed), n_unconfirmed. Rows have what
    their own text holds: those that share an id, or have none, are told apart by a hash of the text; of repeated rows
    each has the notices of one."""
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("text_hash").alias("h"))
    place = F.struct("paragraph", "family")
    found = scan_licenses(docs).groupBy(key.alias("doc")).agg(
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),  # at most the families
        F.count_distinct(F.when(F.col("confirmed"), place)).alias("n_notices"),
        F.count_distinct(F.when(~F.col("confirmed"), place)).alias("n_unconfirmed"),
    )
    out = docs.select("doc_id", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("doc")).join(found, "doc", "left")
    return out.select(
        "doc_id", F.concat_ws(",", F.coalesce("families", F.array().cast("array<string>"))).alias("families"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"),
    )

"""Operator 2: license scans, in DataFrame functions only.

Words of a text make two-word shingles.  Overlapping windows, at a short and a long scale, get MinHash
signatures whose single rows are the bands: a window and a template with similarity s share a band with
probability 1 - (1 - s)^BANDS.  A template of L shingles that lies whole in a window of W shingles has
s >= L / W; scales and bands are checked so that this is at least ``GUARANTEE`` for every template.
Retrieved templates are verified by exact shingle containment in the window.

A template that no window holds is cut into parts of PART words that share one word with the next; each part is
retrieved like a short template.  A part found at a window says where the template would begin and end there, and
containment is taken over the whole template in that stretch of the text, with slack on both sides.

A window that shares a band with a template holds the template's shingle with the least hash in it, so only
windows about such shingles are built; that leaves out no collision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The notices looked for.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Longer texts, looked for beside the notices by the query; OP2_SQL, which knows one window a template, has none.
LONG = {
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "bsd-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: Words in a window and between the starts of two: a run of WORDS - STEP + 1 words lies whole in some window.
SCALES = ((8, 2), (22, 4), (4, 2))
#: The scale of long templates' parts; the last one is for two words, whose one shingle the others hold too rarely.
WIDE = 1
#: Templates that are broadcast at a time; words of a text that are scanned as one row.
BANDS, GUARANTEE, CONTAINMENT, MAX_TEMPLATES, CHUNK = 24, 0.999, 0.75, 10_000, 512
PART = SCALES[WIDE][0] - SCALES[WIDE][1] + 1
SPLIT = "[^a-z0-9]+"


def _scale(words: int) -> int:
    for k, (size, step) in enumerate(SCALES):
        if words <= size - step + 1 and 1 - (1 - max(1, words - 1) / (size - 1)) ** BANDS >= GUARANTEE:
            return k
    raise ValueError(f"no scale holds a template of {words} words with the guaranteed probability")


def _slack(words: Column) -> Column:
    """Words that a long template's stretch has more on either side."""
    return F.lit(SCALES[WIDE][0]) + F.floor(words / 4).cast("int")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def _shingles(words: str) -> Column:
    """Of a column of words, named, so that the words are made once."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def _min_hash(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(band))))


def templates(spark: SparkSession, notices: dict[str, str] = TEMPLATES) -> DataFrame:
    """license, words, whole (its shingles), and of each part: offset (its first word), scale, shingles, signature.
    Templates of one word have no shingles and are not among them."""
    rows = spark.createDataFrame(sorted(notices.items()), "license string, notice string")
    worded = rows.select("license", _words(F.col("notice")).alias("w")).where("size(w) > 1").select("license", F.size("w").alias("words"), "w", F.array_distinct(_shingles("w")).alias("whole"))
    last = F.col("words") - PART
    offsets = F.when(last > 0, F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(PART - 1)), F.array(last)))).otherwise(F.array(F.lit(0)))
    parts = worded.withColumn("offset", F.explode(offsets)).withColumn("w", F.slice("w", F.col("offset") + 1, PART))
    counted = parts.select("license", "words", "whole", "offset", F.size("w").alias("n"), F.array_distinct(_shingles("w")).alias("shingles"))
    scales = {n: _scale(n) for (n,) in counted.select("n").distinct().collect()}
    scale = F.coalesce(*(F.when(F.col("n") == n, k) for n, k in scales.items())) if scales else F.lit(0)
    return counted.select("license", "words", "whole", "offset", scale.alias("scale"), "shingles", F.array(*(_min_hash(F.col("shingles"), k) for k in range(BANDS))).alias("signature"))


def license_scan(docs: DataFrame, notices: dict[str, str] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """One row per document and license found: doc_id, license, containment (the best window's), word (where
    the first such window begins, from 0).  A template of more than PART words has as its windows the stretches
    about its parts.

    Null and empty texts, and those without a letter or digit, find nothing; one-word texts only templates of one
    word.  Rows that repeat a doc_id count as one document; a null doc_id is a document of its own.  Very long texts are
    scanned in chunks that overlap by as much as the longest template may take up, in proportion to their words.  An
    empty table gives no rows.  Other columns are not read.  More than MAX_TEMPLATES templates are scanned for in turn.
    """
    names = sorted(notices)
    parts = [_scanned(docs, {n: notices[n] for n in names[k : k + MAX_TEMPLATES]}, threshold) for k in range(0, max(1, len(names)), MAX_TEMPLATES)]
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    return found


def _single(worded: DataFrame, notices: dict[str, str]) -> DataFrame:
    """Templates of one word: a window of one word either holds it or not."""
    spark = worded.sparkSession
    rows = spark.createDataFrame(sorted(notices.items()), "license string, notice string").select("license", _words(F.col("notice")).alias("w"))
    ones = rows.where("size(w) = 1").select("license", F.col("w")[0].alias("one"))
    sought = sorted({r.one for r in ones.collect()})
    hits = worded.select("doc_id", F.posexplode("w").alias("word", "one")).where(F.col("one").isin(sought))
    return hits.join(F.broadcast(ones), "one").groupBy("doc_id", "license").agg(F.lit(1.0).alias("containment"), F.min("word").alias("word"))


def _scanned(docs: DataFrame, notices: dict[str, str], threshold: float) -> DataFrame:
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("w"))
    known = templates(docs.sparkSession, notices)
    sought = known.select("license", "offset", "scale", F.posexplode("signature").alias("band", "key"))
    wholes = known.select("license", "words", F.col("whole").alias("template")).dropDuplicates(["license"])
    longest = known.agg(F.max("words")).first()[0] or 0
    # The shingle behind each template's band: where its hash is the least.
    behind = known.select("scale", F.explode("shingles").alias("h"), "signature").select(
        "scale", "h", F.explode(F.array(*(F.when(F.xxhash64("h", F.lit(k)) == F.element_at("signature", k + 1), F.col("h")) for k in range(BANDS)))).alias("s")
    )
    keys: dict[int, list[int]] = {k: [] for k in range(len(SCALES))}
    for k, h in behind.where("s is not null").select("scale", "s").distinct().collect():
        keys[k].append(h)
    # Chunks of the text: what follows carries a chunk and its margins, never the text.
    reach = longest + SCALES[WIDE][0] + longest // 4 if longest > PART else 0
    margin = reach + SCALES[WIDE][0]
    whole = worded.where("size(w) > 1").select("doc_id", _shingles("w").alias("all"))
    cuts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / CHUNK).cast("int"))
    chunk = lambda c: F.struct((c * CHUNK).alias("low"), F.greatest(F.lit(0), c * CHUNK - margin).alias("base"), F.slice("all", F.greatest(F.lit(0), c * CHUNK - margin) + 1, c * CHUNK + CHUNK + margin - F.greatest(F.lit(0), c * CHUNK - margin)).alias("all"))
    chunks = whole.select("doc_id", F.explode(F.transform(cuts, chunk)).alias("c")).select("doc_id", "c.low", "c.base", "c.all")

    # The different windows of each scale about the places of such shingles.
    def about(k: int, size: int, step: int) -> Column:
        own = F.transform("all", lambda h, i: F.when(h.isin(keys[k]) & (i + F.col("base") >= F.col("low")) & (i + F.col("base") < F.col("low") + CHUNK), i + F.col("base")))
        starts = lambda pos: F.sequence(F.greatest(F.lit(0), F.ceil((pos - size + 2) / step)).cast("int"), F.floor(pos / step).cast("int"))
        windows = F.array_distinct(F.flatten(F.transform(F.filter(own, lambda p: p.isNotNull()), starts)))
        return F.transform(windows, lambda j: F.struct(F.lit(k).alias("scale"), (j * step).alias("word"), F.lit(size - 1).alias("n")))

    spans = [about(k, size, step) for k, (size, step) in enumerate(SCALES) if keys[k]]
    if not spans:
        return _single(worded, notices)
    begin = F.greatest(F.lit(0), F.col("s.word") - reach)
    stretch = F.when(F.col("s.scale") == WIDE, F.slice("all", begin - F.col("base") + 1, F.col("s.word") + reach - begin))
    wide = [begin.alias("begin"), stretch.alias("stretch")] if reach else []
    windows = chunks.select("doc_id", "base", "all", F.explode(F.concat(*spans)).alias("s")).select("doc_id", "s.scale", "s.word", F.slice("all", F.col("s.word") - F.col("base") + 1, F.col("s.n")).alias("window"), *wide)
    bands = windows.select("*", F.posexplode(F.array(*(_min_hash(F.col("window"), k) for k in range(BANDS)))).alias("band", "key"))
    met = bands.join(F.broadcast(sought), ["scale", "band", "key"])
    met = met.join(F.broadcast(wholes), "license")
    if reach:
        starts = F.col("word") - F.col("offset") - _slack(F.col("words"))
        first = F.greatest(F.lit(0), starts)
        whole = F.slice("stretch", first - F.col("begin") + 1, F.greatest(F.lit(0), F.col("word") - F.col("offset") + F.col("words") + _slack(F.col("words")) - first))
        long = F.col("words") > PART
        met = met.select("doc_id", "license", "template", F.when(long, first).otherwise(F.col("word")).alias("word"), F.when(long, whole).otherwise(F.col("window")).alias("window"))
    held = F.size(F.array_intersect("window", "template")) / F.size("template")
    found = (
        met.select("doc_id", "license", "word", held.alias("containment")).where(F.col("containment") >= threshold)
        .groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min_by("word", F.struct(-F.col("containment"), "word")).alias("word"))
    )
    return found.union(_single(worded, notices))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), TEMPLATES | LONG).select("doc_id", "license", F.round("containment", 6).alias("containment"))


OP2_SQL = f"""
WITH t(license, notice) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))}),
tw AS (SELECT license, list_filter(regexp_split_to_array(lower(notice), '{SPLIT}'), lambda z: z <> '') AS ws FROM t),
ts AS (SELECT DISTINCT license, len(ws) AS n, ws[k] || ' ' || ws[k + 1] AS sh FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM tw)),
tn AS (SELECT license, CASE WHEN any_value(n) <= {SCALES[0][0] - SCALES[0][1] + 1} THEN {SCALES[0][0]} ELSE {SCALES[1][0]} END AS size,
  CASE WHEN any_value(n) <= {SCALES[0][0] - SCALES[0][1] + 1} THEN {SCALES[0][1]} ELSE {SCALES[1][1]} END AS step, count(*) AS m FROM ts GROUP BY license),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda z: z <> '') AS ws FROM documents),
s AS (SELECT doc_id, k - 1 AS pos, ws[k] || ' ' || ws[k + 1] AS sh FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM w)),
p AS (SELECT doc_id, license, size, step, m, pos, s.sh FROM s JOIN ts USING (sh) JOIN tn USING (license)),
v AS (SELECT *, unnest(range(greatest(0, ceil((pos - size + 2) / step))::BIGINT, (pos // step) + 1)) AS k FROM p),
c AS (SELECT doc_id, license, k, count(DISTINCT sh) / any_value(m) AS containment FROM v GROUP BY ALL)
SELECT doc_id, license, round(max(containment), 6) AS containment FROM c WHERE containment >= {CONTAINMENT} GROUP BY ALL
"""

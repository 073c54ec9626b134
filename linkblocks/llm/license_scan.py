"""License scan: Dice coefficient over word bigrams between runs of a text's words and licence templates; DataFrame functions only.

Every run of consecutive words of a text is a candidate, whatever lines it
spans. A run of n bigrams has a Dice coefficient of 2 * shared / (n + m) with a
template of m bigrams, so one that reaches the threshold t shares at least
t * m / (2 - t) bigrams and has at most m * (2 - t) / t. These bounds prune the
templates of a text before any run is looked at; the best runs begin and end
with a bigram of the template, so only those are compared.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Short notices by SPDX-like id.
NOTICES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Texts and headers of public licences, without names and years.
TEXTS = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-2-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
TEMPLATES = NOTICES + TEXTS
#: What separates words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates are broadcast up to this size; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def templates(spark: SparkSession, full: bool = False) -> DataFrame:
    """The notices, short texts and headers that op8's SQL lists; full: the whole texts in licences/ as well, by name and -full.

    A run is compared at each of its steps, so a document that holds a whole
    text of m words costs about m * m / 3 of them.
    """
    whole = [(f"{f.name.removesuffix('.txt')}-full", f.read_text("utf-8")) for f in sorted(resources.files(__package__).joinpath("licences").iterdir(), key=lambda f: f.name)] if full else []
    return spark.createDataFrame(TEMPLATES + whole, "license_id string, text string")


def normalise(text):
    """Words (ASCII letters and digits and characters beyond ASCII, in lower case) with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), GAPS, " "))


def bigrams(plain):
    """Neighbouring words of a normalised text; one word or none has no bigram."""
    words = F.split(plain, " ")
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame, notices: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, license_id, n_starts, dice: the templates that some run of a document's words matches.

    dice is that of the best run; n_starts counts the places where a run that
    reaches the threshold begins with a bigram of the template. Repeated bigrams
    count as often as both have them. Null, empty and one-word texts match
    nothing; repeated rows count each by itself; templates of fewer than two
    words are ignored. Null doc_id is a key like any other.
    """
    spark = docs.sparkSession
    known = notices.select("license_id", normalise(F.col("text")).alias("plain"), bigrams(normalise(F.col("text"))).alias("grams")).withColumn("m", F.size("grams")).filter("m > 0")
    # shared bigrams that a matching run has at least, and bigrams that it has at most
    known = known.withColumn("least", F.ceil(F.col("m") * threshold / (2 - threshold) - 1e-9).cast("int")).withColumn("most", F.floor(F.col("m") * (2 - threshold) / threshold + 1e-9).cast("int"))
    bounds = known.agg(F.min("least").alias("least"), F.sum(F.octet_length("plain")).alias("bytes")).first()
    if bounds["least"] is None:
        return spark.createDataFrame([], "doc_id bigint, license_id string, n_starts bigint, dice double")
    wanted = known.select("license_id", "m", "least", "most", F.explode("grams").alias("gram")).groupBy("license_id", "m", "least", "most", "gram").agg(F.count(F.lit(1)).cast("int").alias("wanted"))
    rows = docs.select(F.col("doc_id").cast("bigint"), bigrams(normalise(F.col("text"))).alias("grams")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("n", F.size("grams")).filter(F.col("n") >= bounds["least"])
    placed = rows.select("doc_id", "row", "n", F.posexplode("grams").alias("at", "gram"))
    met = placed.join(F.broadcast(wanted) if bounds["bytes"] <= BROADCAST_BYTES else wanted, "gram").filter("n >= least")
    # the places of one template's bigrams in one text: at most one a word
    text = met.groupBy("doc_id", "row", "license_id", "m", "least", "most").agg(F.sort_array(F.collect_list(F.struct("at", "gram", "wanted"))).alias("met")).filter(F.size("met") >= F.col("least"))
    dense = lambda i: F.get("met.at", i + F.col("least") - 1) <= F.get("met.at", i) + F.col("most") - 1
    starts = F.filter(F.sequence(F.lit(0), F.size("met") - F.col("least")), dense)
    runs = text.withColumn("first", F.explode(starts)).withColumn("start", F.get("met.at", F.col("first")))
    inside = F.filter(F.slice("met", F.col("first") + 1, F.col("most")), lambda x: x["at"] < F.col("start") + F.col("most"))
    steps = runs.select("doc_id", "row", "license_id", "m", "start", F.explode(inside).alias("s")).select("doc_id", "row", "license_id", "m", "start", "s.*")
    run = ["row", "license_id", "start"]
    nth = F.row_number().over(Window.partitionBy(*run, "gram").orderBy("at"))
    steps = steps.withColumn("counts", (nth <= F.col("wanted")).cast("int"))
    shared = F.sum("counts").over(Window.partitionBy(*run).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    dice = 2 * shared / (F.col("m") + F.col("at") - F.col("start") + 1)
    best = steps.withColumn("dice", dice).groupBy("doc_id", *run).agg(F.max("dice").alias("dice")).filter(F.col("dice") >= threshold)
    return best.groupBy("doc_id", "license_id").agg(F.count(F.lit(1)).alias("n_starts"), F.max("dice").alias("dice"))

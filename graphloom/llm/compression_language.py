"""Language identification by compression: the language whose Zstandard dictionary makes a text smallest.

Each language has one raw-content dictionary, made of labelled texts. A text is lower-cased and encoded with every one, in
blocks, each against the fresh dictionary, so that all of a long text counts alike; the sizes of its blocks are summed. Where the two smallest sizes are too close to tell, the text is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernels as K


#: Bytes of a block. All texts of the given tables are shorter.
BLOCK_BYTES = 1 << 18


def normalise(text: str) -> str:
    return text.lower()


def _coders(dictionaries: dict[str, bytes], level: int) -> dict:
    import zstandard as z

    out = {}
    for name in sorted(dictionaries):
        data = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        out[name] = z.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return out


def _smallest(coders: dict, data: bytes) -> str:
    return min(coders, key=lambda name: len(coders[name](data)))


def learn_dictionaries(labelled: DataFrame, label_col: str = "lang", text_col: str = "text", docs_per_language: int = 192, chars_per_doc: int = 1024, level: int = 6) -> dict[str, bytes]:
    """Raw-content dictionaries by language from rows (label, text).

    The model is fitted on a bounded sample: for each language the docs_per_language texts with the smallest hash, each with
    at most its first chars_per_doc code points. Then lines that half of the sample finds to be of another language than
    the other half's label says are left out (quotations, boilerplate). Rows with a null label, or a text without letters,
    teach nothing; equal texts count once; a language none of whose lines remain keeps them all. Without labelled rows
    there is no dictionary.
    """
    rows = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("mark", F.xxhash64("text"))
    # hashes are spread evenly, so those below a share of their range are about that share of the texts: only these leave the scan
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()}
    wanted = 2 * docs_per_language + 64
    picked: dict[str, list] = {}
    while todo := [lang for lang in sizes if lang not in picked]:
        least = {lang: -(2**63) + min(2**64 - 1, 2**64 * wanted // max(sizes[lang], 1)) for lang in todo}
        limit = F.element_at(F.create_map(*(F.lit(x) for pair in least.items() for x in pair)), F.col("lang"))
        near = rows.where(F.coalesce(F.col("mark") <= limit, F.lit(False))).groupBy("lang", "mark").agg(F.min(F.substring("text", 1, chars_per_doc)).alias("text"))
        found: dict[str, list] = {}
        for row in near.collect():
            found.setdefault(row["lang"], []).append((row["mark"], row["text"]))
        for lang in todo:
            own = sorted(found.get(lang, []))[:docs_per_language]
            if len(own) == docs_per_language or least[lang] == 2**63 - 1:
                picked[lang] = own
        wanted *= 8
    parts: dict[str, list[str]] = {}
    for lang in sorted(picked):
        parts[lang] = [normalise(text) for _, text in picked[lang]]
    halves = [_coders({lang: "\n".join(texts[i::2]).encode() for lang, texts in parts.items() if texts[i::2]}, level) for i in (0, 1)]
    out = {}
    for lang, texts in parts.items():
        kept = [line for i, text in enumerate(texts) for line in text.split("\n") if line and _smallest(halves[1 - i % 2] or halves[i % 2], line.encode()) == lang]
        out[lang] = "\n".join(kept or texts).encode()
    return out


def _blocks(data: bytes) -> list[bytes]:
    """data in parts of about equal size, of BLOCK_BYTES at most."""
    step = -(-len(data) // -(-len(data) // BLOCK_BYTES))
    return [data[i : i + step] for i in range(0, len(data), step)]


def _judge(texts: list, dictionaries: dict[str, bytes], min_margin: float, level: int) -> list[tuple]:
    """(language, score, margin, rejected) of each text."""
    import regex

    key = (tuple(sorted(dictionaries.items())), level)
    if key not in _ready:
        _ready.clear()
        _ready[key] = _coders(dictionaries, level), regex.compile(r"\p{L}").search
    by_name, letter = _ready[key]
    names, coders, rows = list(by_name), list(by_name.values()), []
    for text in texts:
        if not coders or text is None or not letter(text):
            rows.append(("und", 0.0, 0.0, True))
            continue
        data = normalise(text).encode()
        blocks = _blocks(data)
        sizes = [sum(len(c(block)) for block in blocks) for c in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=0)
        margin = 1.0 - sizes[best] / second if second else 1.0
        rows.append((names[best], 1.0 - sizes[best] * len(sizes) / sum(sizes), margin, margin < min_margin))
    return rows


_ready: dict = {}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.0005, level: int = 6) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for every row, from its whole text alone.

    score is 1 - smallest / mean size, from 0 to 1: how much better than all languages the best one does; margin is the
    gap to the second smallest size as a share of it. A row is rejected when its margin is below min_margin, or when its
    text is null or has no letter: then it is `und`, with score 0. Equal sizes go to the first language by name. With one
    dictionary, margin is 1. Null and repeated ids are kept as they are; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in K.spans(batch.column(1), 1 << 21):
                lang, score, margin, rejected = zip(*_judge(batch.column(1).slice(a, b - a).to_pylist(), dictionaries, min_margin, level), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(K.released(run), "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def held_out(id_column):
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.0005, level: int = 6) -> DataFrame:
    """docs, all columns as they are and of any name, without the rows that classify() rejects: null texts and those without a letter among
    them. Each row is judged by its own text; rows do not move between partitions. An empty table gives an empty one."""
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in K.spans(batch.column(place), 1 << 21):
                part = batch.slice(a, b - a)
                judged = _judge(part.column(place).to_pylist(), dictionaries, min_margin, level)
                yield part.filter(pa.array([not rejected for *_, rejected in judged], pa.bool_()))

    return docs.mapInArrow(K.released(run), docs.schema)

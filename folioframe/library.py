"""A library of documents: append-only stage tables under one root, and a manifest that names their live parts.

Every stage takes the rows that the next table lacks, a bounded share at a
time, so that an interrupted ingest goes on where it stopped. A deletion writes
the remaining rows as a new part. Each change is a manifest of the next number;
readers take the highest one, and of two writers one fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import enrich
from .functions.text import CHARS_PER_TOKEN, slugify
from .operators import keyword as K
from .operators import search as S
from .operators import status as ST
from .operators import upserts as U
from .operators.chunking import CHUNK_TOKENS, OVERLAP_TOKENS, chunk_rows
from .operators.sections import SECTION_TOKENS, pack
from .sources import paged
from .sources.registry import read_binary, reader_for, source_type, with_sections

SCHEMAS = {
    "books": "book_id long, slug string, name string, content_hash string, page_count int, author string, source_type string, created_at timestamp",
    "chapters": "book_id long, chapter_index int, title string, page_start long",
    "sections": "book_id long, chapter_index int, section_index int, title string, text string, page_start long",
    "chunks": "book_id long, chapter_index int, section_index int, chunk_index int, raw_text string, page_start long",
    "summaries": "book_id long, chapter_index int, section_index int, summary string",
    "contexts": "book_id long, chapter_index int, section_index int, chunk_index int, context string",
    "vectors": "book_id long, chapter_index int, section_index int, chunk_index int, embedding array<float>",
    "postings": "book_id long, chapter_index int, section_index int, chunk_index int, term string, tf long, dl long, places array<int>",
    "totals": "book_id long, n_docs long, total_dl long",
    "toc_cache": "content_hash string, bounds string, version long",
}
#: Rows of a stage that become visible at a time; manifests that are kept.
COMMIT_ROWS, KEPT = 20_000, 20
SECTION_KEY = ["book_id", "chapter_index", "section_index"]
CHUNK_KEY = [*SECTION_KEY, "chunk_index"]


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # The manifest: live parts by table, the next book id, the embedding model.

    def _numbers(self) -> list[int]:
        """The numbers of the manifests there are, in order."""
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted(int(n[9:-5]) for n in names if re.fullmatch(r"manifest-\d+\.json", n))

    def _read(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            return 0, {"parts": {}, "next_book_id": 1, "embedding_model": None}
        return numbers[-1], json.loads(self.spark.read.text(f"{self.root}/manifest-{numbers[-1]}.json", wholetext=True).first()[0])

    def manifest(self) -> dict:
        return self._read()[1]

    def _swap(self, number: int, manifest: dict) -> None:
        """Make ``manifest``, which follows the one of this number, the live one; an error if another writer was first."""
        new = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        live = self._path(f"{self.root}/manifest-{number + 1}.json")
        if self._fs.exists(live) or not self._fs.rename(new, live):  # a rename in a distributed store fails if the name is taken
            self._fs.delete(new, False)
            raise RuntimeError(f"another writer changed the library at {self.root}; try again")
        for old in self._numbers()[:-KEPT]:
            self._fs.delete(self._path(f"{self.root}/manifest-{old}.json"), False)

    def table(self, name: str) -> DataFrame:
        """The live rows of a table; empty if nothing was written yet."""
        parts = self.manifest()["parts"].get(name, [])
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*parts)

    def _part(self, name: str, rows: DataFrame) -> str:
        """The path of a new part; nothing reads it until a manifest names it."""
        path = f"{self.root}/{name}/part-{uuid.uuid4().hex}"
        names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows = rows.select(*names)
        if name == "postings":  # so that a scan for some terms reads few row groups
            rows = rows.repartitionByRange("term", "book_id", "chapter_index").sortWithinPartitions("term")
        rows.write.parquet(path)
        return path

    def _commit(self, paths: dict[str, str], replace: bool = False, **changes) -> None:
        number, manifest = self._read()
        manifest |= changes
        for name, path in paths.items():
            manifest["parts"][name] = [path] if replace else [*manifest["parts"].get(name, []), path]
        self._swap(number, manifest)

    def _write(self, tables: dict[str, DataFrame], replace: bool = False, **changes) -> None:
        """All tables' new parts become visible together."""
        self._commit({name: self._part(name, rows) for name, rows in tables.items()}, replace, **changes)

    def guard(self, model: str) -> None:
        """One embedding model for a library: the first that is used."""
        number, manifest = self._read()
        if manifest["embedding_model"] is None:
            self._swap(number, manifest | {"embedding_model": model})
        elif manifest["embedding_model"] != model:
            raise ValueError(f"this library holds vectors of {manifest['embedding_model']!r}, not {model!r}")

    # Writing.

    def ingest(self, path: str, client: Callable[[], enrich.ModelClient], name: str | None = None, force: bool = False, **options) -> int:
        """A file, through every stage; its book id."""
        reader_for(path)
        files = self.spark.read.format("binaryFile").load(path)
        return self.ingest_files(files, client, name, force, **options)[0]

    def ingest_files(self, files: DataFrame, client: Callable[[], enrich.ModelClient], name: str | None = None, force: bool = False, models: tuple[str, str] = ("context", "embedding"), **options) -> list[int]:
        """Rows of the ``binaryFile`` source, as one batch of books; their ids."""
        self.guard(models[1])
        ids = self.load(read_binary(files, self._contents(files, client, models[0])), name, force, **options)
        self.enrich(client, models)
        return ids

    def _contents(self, files: DataFrame, client: Callable[[], enrich.ModelClient], model: str) -> DataFrame | None:
        """Chapter bounds for paged books without an outline, from the cache, else from their contents pages by a model; by path."""
        own = files.where(source_type(F.col("path")) == paged.PDF.source_type)
        if own.isEmpty():
            return None
        hashed = own.select(F.col("path").alias("doc_id"), F.sha2("content", 256).alias("content_hash"))
        cached = U.latest(self.table("toc_cache"), ["content_hash"], "version").select("content_hash", "bounds")
        new = hashed.join(cached, "content_hash", "left_anti").select("doc_id")
        ask = lambda: lambda text: client().generate(model, enrich.CONTENTS_ROLE, text)
        made = paged.model_contents(own.join(new.withColumnRenamed("doc_id", "path"), "path", "left_semi"), ask)
        fresh = made.select("content_hash", F.to_json(F.transform("bounds", lambda b: F.array(b["title"], b["page_start"].cast("string"), b["page_end"].cast("string")))).alias("bounds"), F.lit(1).cast("long").alias("version"))
        self._write({"toc_cache": fresh})
        known = U.latest(self.table("toc_cache"), ["content_hash"], "version").join(hashed, "content_hash")
        each = known.select("doc_id", F.posexplode(F.from_json("bounds", "array<array<string>>")).alias("chapter_index", "b"))
        return each.select("doc_id", "chapter_index", F.get("b", F.lit(0)).alias("title"), F.get("b", F.lit(1)).cast("int").alias("page_start"), F.get("b", F.lit(2)).cast("int").alias("page_end"))

    def load(self, paragraphs: DataFrame, name: str | None = None, force: bool = False, section_tokens: int = SECTION_TOKENS, chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[int]:
        """Paragraph rows as books, chapters, sections and chunks. Equal content adds nothing; other content under a known name is an error unless forced."""
        stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
        shown = F.lit(name) if name is not None else F.coalesce(F.nullif(F.first("title"), F.lit("")), F.first(stem))
        heads = paragraphs.groupBy("path", "content_hash").agg(
            shown.alias("name"), F.first("author").alias("author"), F.first("source_type").alias("source_type"),
            F.when(F.first("source_type").isin("epub", "pdf"), F.max("chapter_index") + 1).otherwise(F.count("text")).cast("int").alias("page_count"),
        )
        incoming = heads.withColumn("slug", slugify(F.col("name")))
        judged = U.resolve_identity(self.table("books"), incoming).join(self.table("books").select("slug", F.col("book_id").alias("_have")), "slug", "left")
        found = judged.orderBy("slug", "path").collect()  # a row for each file of the batch
        slugs = [r["slug"] for r in found]
        if len(set(slugs)) < len(slugs):
            raise ValueError(f"two files of one batch have the same name: {sorted({s for s in slugs if slugs.count(s) > 1})}")
        clash = [r["slug"] for r in found if r["action"] == "conflict"]
        if clash and not force:
            raise ValueError(f"another document is called {', '.join(clash)} already; force replaces it")
        for slug in clash:
            self.delete(slug)
        following = self.manifest()["next_book_id"]
        new = [r for r in found if r["action"] != "keep"]
        ids = {r["path"]: r["_have"] if r["action"] == "keep" else following + new.index(r) for r in found}
        pairs = self.spark.createDataFrame([(p, i) for p, i in ids.items()], "path string, book_id long")
        rows = with_sections(paragraphs).join(F.broadcast(pairs), "path")  # a row for each file
        chapters = rows.groupBy("book_id", "chapter_index").agg(F.first("chapter_title").alias("title"), F.min("chapter_start").alias("page_start"))
        order = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("loc", "text"))))
        packed = F.when(F.size(order) > 0, pack(order, section_tokens * CHARS_PER_TOKEN)).otherwise(F.array(F.struct(F.lit(0).alias("section_index"), F.lit("").alias("text"), F.min("chapter_start").alias("page_start"))))
        plain, titled = rows.where("section_index is null"), rows.where("section_index is not null")
        sections = plain.groupBy("book_id", "chapter_index").agg(packed.alias("_s")).select("book_id", "chapter_index", F.explode("_s").alias("_s")).select("book_id", "chapter_index", "_s.section_index", F.lit(None).cast("string").alias("title"), "_s.text", "_s.page_start")
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loc", "text"))), lambda x: x["text"]), "\n\n")
        sections = sections.unionByName(titled.groupBy(*SECTION_KEY).agg(F.first("section_title").alias("title"), whole.alias("text"), F.min("loc").alias("page_start")))
        chunks = chunk_rows(sections.drop("title"), "text", chunk_tokens, overlap_tokens)
        books = incoming.join(F.broadcast(pairs), "path").withColumn("created_at", F.current_timestamp())
        self._write(
            {
                "books": U.insert_absent(self.table("books"), books, ["book_id"]),
                "chapters": U.insert_absent(self.table("chapters"), chapters, ["book_id", "chapter_index"]),
                "sections": U.insert_absent(self.table("sections"), sections, SECTION_KEY),
                "chunks": U.insert_absent(self.table("chunks"), chunks, CHUNK_KEY),
            },
            next_book_id=following + len(new),
        )
        return [ids[r["path"]] for r in found]

    def enrich(self, client: Callable[[], enrich.ModelClient], models: tuple[str, str] = ("context", "embedding"), commit_rows: int = COMMIT_ROWS) -> None:
        """Summaries, then contexts, then vectors with their postings, each for what lacks them. All generation is over before embedding begins.

        About ``commit_rows`` rows of a stage become visible at a time, so that an
        interrupted stage loses no more calls than these.
        """
        for rows in self._shares(enrich.unsummarized(self.table("sections"), self.table("summaries")), SECTION_KEY, commit_rows):
            self._write({"summaries": enrich.summarize(rows, client, models[0])})
        for rows in self._shares(enrich.uncontextualized(self.table("chunks"), self.table("contexts")), CHUNK_KEY, commit_rows):
            self._write({"contexts": enrich.contextualize(rows, self.table("summaries"), client, models[0])})
        for rows in self._shares(enrich.unembedded(self.table("chunks"), self.table("contexts"), self.table("vectors")), CHUNK_KEY, commit_rows):
            vectors = self._part("vectors", enrich.embed(rows, client, models[1]))
            done = self.spark.read.schema(SCHEMAS["vectors"]).parquet(vectors).select(*CHUNK_KEY)
            self._commit({"vectors": vectors} | self._postings(rows.join(done, CHUNK_KEY, "left_semi")))

    def _shares(self, open_: DataFrame, key: list[str], commit_rows: int) -> Iterator[DataFrame]:
        """The open rows in shares by a hash of their keys, of about ``commit_rows`` each."""
        n = -(-open_.count() // commit_rows)
        for k in range(n):
            yield open_.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k) if n > 1 else open_

    def _postings(self, chunks: DataFrame) -> dict[str, str]:
        """New parts of the keyword index for chunks with their contexts."""
        keyed = chunks.withColumn("_key", F.struct(*CHUNK_KEY))
        path = self._part("postings", K.postings(keyed, "_key", "raw_text", "context", places=True).select("key.*", "term", "tf", "dl", "places"))
        own = K.lengths(keyed, "_key", "raw_text", "context")
        totals = own.groupBy("key.book_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_dl"))
        return {"postings": path, "totals": self._part("totals", totals)}

    def keyword_index(self) -> K.KeywordIndex:
        """The stored index over all embedded chunks, by ``search.chunk_key``; a totals row for each book and commit."""
        found = self.table("postings").select(F.struct(*CHUNK_KEY).alias("key"), "term", "tf", "dl", "places")
        n = F.sum("n_docs")
        return K.KeywordIndex(found, self.table("totals").agg(F.coalesce(n, F.lit(0)).alias("n_docs"), (F.sum("total_dl") / F.nullif(n, F.lit(0))).alias("avg_dl")))

    def delete(self, slug: str) -> None:
        """A book with everything that belongs to it; its id is not used again."""
        row = self.table("books").where(F.col("slug") == slug).first()
        if row is None:
            raise KeyError(f"no book is called {slug!r}")
        with_id = [t for t in SCHEMAS if t != "toc_cache" and self.manifest()["parts"].get(t)]
        self._write({t: U.delete_where(self.table(t), "book_id", row["book_id"]) for t in with_id}, replace=True)

    def rebuild_keyword_index(self, book_id: int | None = None) -> int:
        """Postings of embedded chunks anew, for one book or all; how many chunks they cover."""
        rows = self.chunks().where(F.col("embedding").isNotNull())
        if book_id is not None:
            rows = rows.where(F.col("book_id") == book_id)
        fresh = self._postings(rows)
        if book_id is not None:
            for name in ("postings", "totals"):
                new = self.spark.read.schema(SCHEMAS[name]).parquet(fresh[name])
                fresh[name] = self._part(name, new.unionByName(U.delete_where(self.table(name), "book_id", book_id)))
        self._commit(fresh, replace=True)
        return rows.count()

    def put_toc(self, content_hash: str, bounds: list[tuple[str, int, int]]) -> None:
        row = self.spark.createDataFrame([(content_hash, json.dumps(bounds))], "content_hash string, bounds string")
        version = self.table("toc_cache").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        self._write({"toc_cache": row.withColumn("version", F.lit(version).cast("long"))})

    def get_toc(self, content_hash: str) -> list[tuple[str, int, int]] | None:
        row = U.latest(self.table("toc_cache").where(F.col("content_hash") == content_hash), ["content_hash"], "version").first()
        return None if row is None else [(t, int(a), int(b)) for t, a, b in json.loads(row["bounds"])]

    # Reading.

    def books(self) -> DataFrame:
        return self.table("books").orderBy("book_id")

    def chunks(self) -> DataFrame:
        return ST.with_status(self.table("chunks"), self.table("contexts"), self.table("vectors"))

    def status(self) -> DataFrame:
        return ST.library_status(self.books(), self.table("chapters"), self.table("sections"), self.chunks())

    def outline(self, book_id: int) -> DataFrame:
        self._book(book_id)
        own = lambda t: self.table(t).where(F.col("book_id") == book_id)
        return ST.outline(own("chapters"), own("sections")).orderBy("chapter_index")

    def section(self, book_id: int, chapter_index: int, section_index: int):
        """One section's row."""
        row = self.table("sections").where((F.col("book_id") == book_id) & (F.col("chapter_index") == chapter_index) & (F.col("section_index") == section_index)).first()
        if row is None:
            raise ValueError(f"no section {chapter_index}.{section_index} in book {book_id}")
        return row

    def _book(self, book_id: int):
        row = self.table("books").where(F.col("book_id") == book_id).first()
        if row is None:
            raise ValueError(f"no book {book_id}")
        return row

    def search(self, questions: list[str] | DataFrame, client: Callable[[], enrich.ModelClient], model: str = "embedding", mode: str = "hybrid", filters: S.Filters | None = None, top_k: int | None = None, expand: bool = False) -> DataFrame:
        """Cited excerpts for questions; a list of texts, or rows ``(query_id, text, vector)``."""
        if mode not in S.MODES:
            raise ValueError(f"mode must be one of {', '.join(S.MODES)}, not {mode!r}")
        self.guard(model)
        if not isinstance(questions, DataFrame):
            vectors = client().embed(model, list(questions))
            questions = self.spark.createDataFrame([(i, t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(questions, vectors, strict=True))], "query_id int, text string, vector array<float>")
        rows = S.search_rows(self.table("books"), self.table("chapters"), self.table("sections"), self.chunks())
        return S.search(rows, questions, mode, filters, top_k, sections=self.table("sections") if expand else None, index=self.keyword_index())

"""Tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = "Sphinx of black quartz, judge my vow. "


def _texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 300))) for _ in range(40)]
    near = []
    for text in base[:12]:
        words = text.split()
        words[len(words) // 2] = rng.choice(vocabulary)
        near.append(" ".join(words))
    odd = [
        None, None, "", "", " \t\r\n ", "a", "One two", "A B c", "ÀÉÎ straße İstanbul ﬁ é 日本語のテキスト", "<|endoftext|> and <|startoftext|>", "don't they're we'll I'd it's 'tis 're", "\x00\x1f\x7f ctrl",
        "12345 67 8.90 ½ ²", "no-break space em line", "x" * 5000, LONG * 3000, "word " * 20000, "…—–‘’“”", "🙂👍🏽" * 50, "tab\tsep\x0bvt\x0cff", "!!! ??? ...",
    ]
    return base + near + base[:6] + odd


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    texts = _texts()
    ids = [i * 7 % 997 for i in range(len(texts))]
    extra = pa.array(range(len(texts)), pa.int64())
    langs = [None if t is None else ("xx", "yy")[i % 2] for i, t in enumerate(texts)]
    documents = pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": pa.array(langs, pa.string()), "source": pa.array(["s"] * len(texts)), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        "_text": extra, "_doc": extra, "print": extra, "component_id": extra, "_gone": extra, "_twice": extra, "k_0": extra, "_k0": extra, "size": extra, "part": extra, "rank": extra, "count": extra, "root": extra,
    })
    pq.write_table(documents, folder / "documents.parquet")
    words = texts[3].split()
    items = [
        ("b1", " ".join(words[4:20])), ("b2", " ".join(words[10:30]).upper()), ("b3", "one TWO"), ("b4", None), ("b5", ""), ("b6", "... !!!"), ("b7", texts[20]), ("b8", texts[20]),
        ("b9", "word " * 30), ("b10", LONG), ("b11", "a"), ("b12", "日本語のテキスト"),
    ]
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": pa.array([t for _, t in items], pa.string()), "window": pa.array(range(len(items)))}), folder / "benchmark.parquet")
    htmls = ["<p>" + "copy " * 300, None, "", "<p>short", "<p>short", "x" * 1000, "x" * 1000, "x" * 999, "x" * 999, "é" * 600, "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 90, "a\r\n\r\nb" * 300]
    rows = [(i, [f"http://a.example/{i}", None, "not a url", "https://x.y.example.org/a/b/../c?q=1#f", "http://Host.EXAMPLE:8080/%20/"][i % 5], htmls[i % len(htmls)]) for i in range(40)]
    pages = {"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string())}
    pq.write_table(pa.table(pages | {"_page": pa.array(range(40)), "_key": pa.array(range(40)), "matched": pa.array(range(40))}), folder / "pages.parquet")
    rng = random.Random(9)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(300)]
    vectors[50] = vectors[200] = vectors[100]
    vectors[3], vectors[4], vectors[5], vectors[6] = None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7
    vectors[7], vectors[8] = [float("inf")] + [1.0] * 7, [-x for x in vectors[100]]
    pq.write_table(pa.table({"vec_id": pa.array(range(300), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(range(300)), "vec": pa.array(range(300)), "class": pa.array(range(300))}), folder / "embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(odd_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    for name in ("documents", "benchmark", "pages", "embeddings"):
        pq.write_table(pq.read_table(f"{odd_dir}/{name}.parquet").slice(0, 0), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(params=["small", "odd", "empty"])
def tables(request, odd_dir, empty_dir):
    return {"small": "/root/testdata/sf0.001", "odd": odd_dir, "empty": empty_dir}[request.param]

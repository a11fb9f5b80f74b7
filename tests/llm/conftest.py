import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm import fixtures


def write(folder, documents: pd.DataFrame, pages: pd.DataFrame, vectors: list[tuple] = ()) -> str:
    kinds = {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32(), "x": pa.string(), "length": pa.string(), "score": pa.string()}
    columns = list(zip(*vectors, strict=True)) if vectors else [[] for _ in kinds]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds)), f"{folder}/embeddings.parquet", row_group_size=40)
    text = {"text": pa.string(), "lang": pa.string(), "source": pa.string(), "url": pa.string(), "doc_id": pa.int64(), "n_chars": pa.int64(), "page_id": pa.int64(), "key": pa.string(), "range": pa.string(), "host": pa.string(), "verdict": pa.string()}
    for name, table in (("documents", documents), ("pages", pages)):
        schema = pa.schema([(c, text.get(c, pa.string())) for c in table.columns])
        arrays = [pa.array([None if pd.isna(v) else str(v) if schema.field(c).type == pa.string() else int(v) for v in table[c]], schema.field(c).type) for c in table.columns]
        pq.write_table(pa.table(arrays, schema=schema), f"{folder}/{name}.parquet", row_group_size=40)
    return str(folder)


@pytest.fixture(scope="session")
def edge_rows():
    table = fixtures.documents()
    return list(zip(table.doc_id.tolist(), table.text.tolist(), strict=True))


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("edge"), fixtures.documents(), fixtures.pages(), fixtures.vectors())


@pytest.fixture(scope="session")
def repeated_dir(tmp_path_factory):
    """The edge tables with two rows out of three the same."""
    documents = fixtures.documents()
    same = pd.concat([documents[documents.doc_id == 10]] * (2 * len(documents)))
    return write(tmp_path_factory.mktemp("repeated"), pd.concat([documents, same]), fixtures.pages(), fixtures.vectors() + fixtures.vectors()[-1:] * 300)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), fixtures.documents().head(0), fixtures.pages().head(0))


@pytest.fixture(scope="session")
def null_dir(tmp_path_factory):
    """One row, null in every column."""
    documents, pages = fixtures.documents().head(1), fixtures.pages().head(1)
    return write(tmp_path_factory.mktemp("null"), documents.map(lambda v: None), pages.map(lambda v: None), [(None,) * 6])

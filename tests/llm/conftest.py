import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").persist()


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs, with extra columns whose names operators use inside."""

    def make(pairs, **more):
        schema = DOCS + ", block string, digest string, _hash string, _row string, _draw string, _hit string"
        return spark.createDataFrame([(d, t, more.get("lang"), "s", len(t or ""), "b", "d", "h", "r", "w", "x") for d, t in pairs], schema).repartition(3)

    return make

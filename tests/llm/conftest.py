import pytest


@pytest.fixture
def sf(tmp_path, spark):
    """Write tables given as name=DataFrame and return their folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write

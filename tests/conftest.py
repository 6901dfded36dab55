import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4, memory="4g")
    session.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    yield session
    session.stop()

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
         .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def lexicon():
    from redpencil.lexicon import Lexicon

    return Lexicon(
        brand_terms=["HarborLight", "Silver Fern", "Jam-Jar", "Silver Fern House"],
        protected_terms=["HarborLight", "Silver Fern"],
        do_not_change=["LinkedIn", "YouTube", "DockYard"],
        preferred_spellings={"recieve": "receive"},
        product_terms={"fern tea": "Fern Tea", "river boat": "RiverBoat"},
        preferred_wording={"ngon lành": "tuyệt vời"},
        missing_tone_map={"dich vu": "dịch vụ"},
        wrong_tone_map={"chuẫn": "chuẩn"},
        legacy_names={"oldmill": "Millbrook Group"},
        acronyms=["API"],
        value_words=["harbor"],
    )

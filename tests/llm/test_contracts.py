"""Columns of all numbered queries, in the order that their contracts list them; further ones may follow."""

import pytest

from rankforge.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id held_out score predicted", 2: "query_id rank vec_id score", 3: "doc_id size source_size target taken", 4: "doc_id class_id",
    5: "doc_id held_out lang_pred score", 6: "query_id rank vec_id score", 7: "doc_id piece start length ids_crc32 sequence_id offset",
    8: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", 9: "page_id host path rule verdict", 10: "",
    11: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256", 12: "vec_id code error label_error codebooks_sha256",
    13: "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("name", list(registry.queries()))
def test_columns(spark, name):
    want = COLUMNS[int(name[2:].split("_")[0])].split()
    assert registry.queries()[name](spark, SF).columns[: len(want)] == want


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))

"""Operator 3's rejection: noise and unlearned languages go, every clean document stays."""

import base64
import random

from barloom.llm import langid

SF = "/root/testdata/sf0.01"
HUNGARIAN = "Az emberek szabadnak születnek és egyenlő méltóságuk van, ezért egymással szemben testvéri szellemben kell viseltetniük."
FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."


def test_noise_and_unlearned_languages_go(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz "
    junk = [HUNGARIAN, FINNISH]
    for n in (100, 300, 2000):
        junk += ["".join(rng.choice(letters) for _ in range(n)), base64.b64encode(rng.randbytes(n)).decode(), rng.randbytes(n).hex()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    clean = {r.doc_id for r in docs.select("doc_id").collect()}
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == clean

"""Toxic words of a small part of the confirmed texts weigh, however many these are."""

import random
import zlib

from turnmill.llm.toxicity import train_toxicity


def test_words_of_few_confirmed_texts_weigh(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    plain = [word() for _ in range(500)]
    prose = lambda: " ".join(rng.choice(plain) for _ in range(12))
    taught = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = taught[:400]
    rare = set(toxic[::66][:6])
    texts = {i: prose() for i in range(3000)}
    for i in toxic:
        texts[i] += " zurgle" if i in rare else " qwyxxo"
    docs = spark.createDataFrame([*texts.items(), (9000, "zurgle"), (9001, plain[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in set(toxic))) for i in taught], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in train_toxicity(docs, labels).scores(docs.where("doc_id >= 9000")).collect()}
    assert got[9000] > 0.5 > got[9001]

from lodeworks.functions.tokenizers import FileTokenizer


def test_texts_are_encoded_in_bounded_stretches(spark):
    class Few:
        def encode_batch(self, texts, add_special_tokens):
            from types import SimpleNamespace

            if sum(map(len, texts)) > 500_000:
                raise MemoryError(f"{len(texts)} texts at once")
            return [SimpleNamespace(ids=[ord(c) for c in x]) for x in texts]

    class Bounded(FileTokenizer):
        @staticmethod
        def _file(path):
            return Few()

    texts = [None if i == 7 else "ab" * (i % 5 * 500) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    got = dict(docs.select("i", Bounded("none").ids(docs.text)).collect())
    assert got == {i: None if x is None else [ord(c) for c in x] for i, x in enumerate(texts)}

"""The sample of ordinary words that the secret models are fitted to."""

from penstroke.llm import secrets


def test_all_words_are_drawn_where_they_fit(spark, monkeypatch):
    words = {f"word{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)}
    docs = spark.createDataFrame([(k, " ".join(sorted(words)) + (" once" if k else "")) for k in range(2)], "doc_id long, text string")
    drawn = []
    monkeypatch.setattr(secrets, "identifiers", lambda found: drawn.append(found) or found)
    monkeypatch.setattr(secrets, "random_strings", lambda: ["aB3" * 6])
    secrets.fit(docs)
    secrets.fit(docs, 50)
    assert set(drawn[0]) == words and len(drawn[0]) == len(words)
    assert drawn[1] == drawn[0][:50]

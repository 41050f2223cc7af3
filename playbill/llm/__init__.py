"""Training-data operators: near-duplicates, secrets, quality, decontamination, chat, licences, shards, tokens, fingerprints."""

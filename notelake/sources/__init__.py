"""Readers and writers: vault listing, batch files, the versioned store, the embedder hook."""

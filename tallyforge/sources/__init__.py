"""Reading and writing: versioned snapshots, spreadsheets, pages, JSON services, caches, manifests, content-addressed sinks."""

"""Tables on storage: the lake, the release catalogue, surveys and archives."""

"""Where audits read from and write to: registries, logs, documents, responses, meta tables."""

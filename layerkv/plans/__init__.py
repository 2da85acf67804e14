"""Control plane of a store: options, manifests, commits, maintenance."""

"""Where rows come from and go to: file scans, lines, manifests, reports, sinks."""

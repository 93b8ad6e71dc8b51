"""Where rows with series come from: tables of events, files of recordings, generators."""

"""DataFrame operators for media-production data: capture libraries, catalogued moments,
timed text, rendered-video checks and published-post results."""

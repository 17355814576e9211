"""Wordings that no exemplar has. TUNED and GENUINE were looked at while thresholds and synonyms were set; FRESH and FRESH_GENUINE were written afterwards,
measured (86 of 107, 1 of 20) and then looked at; LAST and LAST_GENUINE were written after that and not looked at."""

TUNED = {
    "scripts": [
        "JavaScript is required for this website to work properly.", "Your browser must have JavaScript activated to use this service.", "Please turn on JavaScript in your browser settings and try again.", "This web page needs JavaScript to be enabled.",
        "You have JavaScript disabled. Please enable it to see the full site.", "Sorry, you need to enable JavaScript to visit this website.", "To use this application, JavaScript must be turned on.", "JavaScript is not enabled in your browser.", "We noticed that JavaScript is turned off in this browser.",
        "This app works best with JavaScript enabled.", "Scripts are blocked, so this page cannot be displayed.", "Your browser does not have scripting enabled.", "In order to view the comments, enable JavaScript.", "Please activate JavaScript and reload this page.",
        "The interactive map requires JavaScript.", "JavaScript needs to be allowed for the login form to work.", "If you are seeing this message, JavaScript is disabled in your browser.", "Content is not shown because your browser blocks scripts.",
        "Für die Nutzung dieser Website muss JavaScript aktiviert sein.", "Bitte schalten Sie JavaScript in den Einstellungen Ihres Browsers ein.", "请在浏览器中启用 JavaScript 以查看此页面", "此网站需要启用 JavaScript", "Please allow scripts for this site and refresh.", "Enable scripts in your browser to continue.",
    ],
    "error": [
        "The page you are looking for does not exist.", "We can't seem to find the page you're looking for.", "Sorry, the page you requested was not found.", "Oops, this page could not be found.", "The requested resource could not be found on this server.", "This link is broken or the page has been moved.", "The page may have been removed or is temporarily unavailable.",
        "The article you requested no longer exists.", "404 - File or directory not found.", "HTTP Error 404: The requested resource is not found.", "Sorry, this content isn't available right now.", "An internal server error occurred.", "Sorry, something went wrong. Please try again.", "Something went wrong while loading this page.", "An error occurred while processing your request, please try again later.",
        "The server encountered an error and could not complete your request.", "500 - Internal server error.", "HTTP Error 503. The service is unavailable.", "The server is temporarily unavailable, please try again later.", "We are currently down for maintenance.", "This site is undergoing scheduled maintenance.", "Our website is temporarily unavailable due to maintenance.",
        "The gateway did not receive a timely response from the upstream server.", "The connection was reset.", "The server took too long to respond.", "This page isn't working right now.", "Unable to connect to the server, check your internet connection.", "Failed to load the page, please reload.", "We could not load this content. Retry", "You don't have permission to view this page.",
        "You are not allowed to access this resource.", "Access to this resource on the server is denied!", "Sorry, you have been blocked.", "You are unable to access this site because your address was blocked.", "This repository has been disabled by its owner.", "You need to log in to view this page.", "Please sign in to continue reading.", "You must log in to see the rest of this document.", "Your session timed out. Please log in again.", "Too many requests, please wait a few seconds.",
        "You have been rate limited, try again in a few minutes.", "Please wait while we check your browser.", "Verify you are human by completing the action below.", "To continue, please prove that you are not a robot.", "We detected unusual traffic from your computer network.", "Bad request: your browser sent an invalid request.", "A fatal error occurred, uncaught exception.", "Database connection error",
        "Diese Seite konnte nicht gefunden werden.", "Die gesuchte Seite wurde nicht gefunden.", "Es ist ein interner Serverfehler aufgetreten.", "Zugriff auf diese Seite verweigert.", "Bitte melden Sie sich an, um diese Seite anzuzeigen.", "Diese Seite ist wegen Wartungsarbeiten nicht erreichbar.", "抱歉,您访问的页面不存在", "页面找不到了,返回首页", "服务器出错了,请稍后再试", "您没有权限访问该页面", "请登录后继续访问", "系统繁忙,请稍后重试",
    ],
    "template": [
        "Hello {customer_name}, welcome back.", "Dear [First Name], thank you for your order.", "{{#each items}}", "Hi {{ user.first_name }},", "Dear Mr. [Last Name],", "Your invoice ${invoice_number} is due on ${due_date}.", "<%= @user.name %> has sent you a message.", "{% if user %} Welcome {% endif %}", "Dear %%FIRSTNAME%%,", "Hello *|FNAME|*, here is your newsletter.", "[INSERT COMPANY NAME HERE]", "<your name here>",
        "Welcome back, {username}.", "Insert your text here.", "Your content goes here.", "Add a short description here.", "Enter your text here.", "Replace this text with your own.", "This is a sample paragraph, edit it to add your content.", "This is some placeholder text.", "Add text here", "Write a summary of the problem in a few sentences.", "Please complete this section before submitting.",
        "More content coming soon.", "This page is currently under construction.", "This section has been intentionally left blank.", "No content yet.", "Description goes here.", "Error: undefined variable in template", "undefined undefined", "Fügen Sie Ihren Text hier ein.", "Dies ist ein Beispieltext.", "Diese Seite ist noch im Aufbau.", "请在这里输入标题", "示例文字,请替换", "Ihr Text hier.",
    ],
    "filler": [
        "Lorem ipsum is simply dummy text of the printing industry.", "Lorem ipsum dolor sit amet.", "Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor.", "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum.", "Dolor sit amet, consectetur adipiscing elit.", "Sed do eiusmod tempor incididunt ut labore.",
        "Quis nostrud exercitation ullamco laboris nisi.", "blah blah blah blah", "Blah, blah, blah.", "asdf asdf", "test test test test test", "TODO TODO", "Filler text filler text.", "dummy text", "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.", "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.",
    ],
}

GENUINE = [
    "The parser counts a page as not found if the server answers with 404.", "Our tests run with JavaScript turned off to see whether the page degrades well.", "The client retries when the gateway times out and gives up after five tries.", "The article explains how to enable JavaScript in older browsers and why some people disable it.",
    "Access is denied to guests, but editors may open the draft and leave notes.", "She wrote the error page in one afternoon and tested it on a slow phone.", "The session expires after twenty minutes, which is set in the server's configuration.", "The rate limiter keeps a bucket of tokens per user and refuses calls once the bucket is empty.",
    "Maintenance of the old bridge starts in March and takes about six weeks.", "The template has a slot for the author's name and another for the date of the review.", "Placeholders in the form are grey until the user starts to type.", "The printer's lorem ipsum comes from a work by Cicero.", "A bad gateway answer from the proxy is logged with the name of the upstream.",
    "You can sign in with a key instead of a password, which the handbook recommends.", "The function returns an error if the file does not exist, and the caller shows a dialog.", "We moved the documents to another server and left a redirect behind.", "The build failed because the include path was missing from the settings.", "Please check your results against the table in appendix B before you publish them.",
    "The browser loads scripts in the order in which they are listed.", "Unusual traffic on the ring road was caused by a concert.", "The owner of the shop restricted access to the roof after the storm.", "The fox was quick and brown, and the dog did not wake up.", "Try the second door if the first one is locked.", "The map shows where each page of the manuscript was found.",
    "The host could not be reached for two hours on Monday, so the job was run again at night.", "The test covers what happens if the user has no permission.", "A description of the unit is kept in the header of each file.", "They asked us to write two sentences about the finding for the newsletter.", "The service is unavailable on public holidays, as the sign on the door says.", "The reviewer asked whether the session key is ever written to disk.",
]

FRESH = {
    "scripts": [
        "This page uses JavaScript. Please enable it in your browser.", "JavaScript must be enabled to use this feature.", "Your browser has JavaScript turned off.", "Please switch on JavaScript to see the content of this page.", "We need JavaScript to show you this page.", "Turn on JavaScript to continue.",
        "JavaScript is currently disabled in your browser and is required to view this site.", "Sorry, this site does not work without JavaScript.", "This website makes heavy use of JavaScript, please enable it.", "You must enable JavaScript and cookies to use this site.", "Some parts of this site need JavaScript.", "No JavaScript? This page will not work.",
        "Scripting is disabled; the viewer cannot start.", "Please make sure JavaScript is enabled in your browser settings.", "Bitte JavaScript aktivieren.", "Diese Website funktioniert nur mit JavaScript.", "您需要启用 JavaScript 才能使用本网站", "浏览器不支持脚本,页面无法显示",
    ],
    "error": [
        "Sorry, we could not find that page.", "That page doesn't exist!", "The URL you requested could not be found.", "The requested file was not found.", "Nothing was found here.", "Page no longer available.", "This post has been deleted.", "The document has been removed by its owner.", "We couldn't find what you were looking for.",
        "404: This page could not be found.", "Oops! Something went wrong.", "Sorry, an unexpected error has occurred.", "There was an error processing your request.", "The application has encountered an unknown error.", "Server error. Please try again in a moment.", "Internal server error: the request could not be completed.", "The website is temporarily unable to service your request.",
        "This service is down for maintenance.", "We will be back soon, the site is being updated.", "The server is too busy at the moment.", "Gateway timeout: the server did not respond.", "Bad gateway", "Request timed out, try again.", "Your connection was interrupted.", "This site is unreachable.", "Could not connect to the database.", "Error loading page.", "Failed to load content. Tap to retry.",
        "Access is forbidden.", "You are not authorized to access this page.", "Permission denied: you cannot view this document.", "This page is private.", "Your access has been blocked for security reasons.", "Please sign in to view this content.", "Log in or sign up to continue reading.", "You have been logged out, please log in again.", "Session expired", "You need an account to read this page.",
        "You have sent too many requests in a given amount of time.", "Rate limit exceeded, please slow down.", "Are you a robot?", "Please complete the security check to access the site.", "One more step: confirm you are human.", "Our systems have detected unusual traffic from your network.", "Your request was blocked.",
        "Fehler 404: Seite nicht gefunden.", "Leider ist ein Fehler aufgetreten.", "Sie haben keine Berechtigung, diese Seite anzuzeigen.", "Der Dienst ist vorübergehend nicht verfügbar.", "您查找的页面不存在", "网页无法访问", "系统错误,请稍后重试", "请先登录",
    ],
    "template": [
        "Dear {first_name},", "Hello [Customer Name],", "Hi {{name}}!", "Welcome, ${user}", "{{ page.title }}", "{{> header}}", "<%= title %>", "[YOUR COMPANY]", "[INSERT DATE]", "[[summary]]", "__COMPANY_NAME__", "%%UNSUBSCRIBE%%", "Sincerely, [Name]", "Add your text here.", "Enter description here", "Type your message here",
        "This is a sample text.", "Replace this text.", "Edit this section to add content.", "Placeholder text goes here.", "Please fill in this field.", "Content will be added soon.", "Page under construction.", "This section is empty.", "Hier Text eingeben.", "Platzhaltertext", "在此添加内容", "内容建设中",
    ],
    "filler": ["Lorem ipsum", "Lorem ipsum dolor sit", "Ut labore et dolore magna aliqua.", "Duis aute irure dolor in voluptate velit.", "blah blah", "test test", "bla bla bla bla", "TBD TBD"],
}

FRESH_GENUINE = [
    "The reading room is closed on Mondays and opens again on Tuesday at nine.", "We found the missing page of the diary in a drawer on the second floor.", "The script writes one line per record and stops if the disk is full.", "Nobody could say which of the two servers had answered first.", "An error in the second table was corrected before the report went out.",
    "The user's session is kept in memory and is lost when the process ends.", "The door to the archive is blocked by a cabinet, so use the one at the back.", "Enable the flag only on machines that have more than one disk.", "The request was sent to the committee, which has not answered yet.", "In the sample the text of the letter is shown next to the scan.",
    "Please bring the signed form to the office, and ask for a copy.", "The browser test takes about five seconds on the new machine.", "Insert the card into the slot and wait for the green light.", "The description of the method was moved to the appendix.", "They tried again later and found that the site had been dug up.",
    "The content of the box was not what the label said.", "The network was slow because of the traffic between the two halls.", "If the value is not defined, the default of the template is used.", "This chapter describes how the gateway decides which host to ask.", "The page limit of the journal is twelve, without references.",
]

LAST = {
    "scripts": [
        "Please enable JavaScript to use all features.", "Your browser doesn't support JavaScript or it is disabled.", "JavaScript must be turned on to view this page.", "You are viewing this page without JavaScript; some content will not load.", "Enable JavaScript in your browser's settings, then reload.", "This site relies on JavaScript to display content.",
        "It looks like JavaScript is disabled.", "The comments need JavaScript to load.", "We require JavaScript to be enabled.", "Without scripts this site cannot work.", "To see this page, please allow scripts.", "Scripts are turned off in your browser.", "Please check that JavaScript is enabled.", "Sorry, your browser blocks JavaScript.",
        "JavaScript ist in Ihrem Browser deaktiviert.", "Bitte aktivieren Sie JavaScript und laden Sie die Seite neu.", "请打开浏览器的 JavaScript 功能", "本页面需要 JavaScript 支持",
    ],
    "error": [
        "The page you requested does not exist.", "Sorry, but the page you were trying to view does not exist.", "This page can't be displayed.", "We're sorry, the page you requested cannot be found.", "The requested page is not available.", "The document you requested was not found.", "The link may be outdated or the page was deleted.", "No such page.", "This entry has been removed.",
        "This file is no longer available.", "Error: the requested resource does not exist.", "404 error", "Whoops, something went wrong.", "An unexpected error happened, please try again.", "The server could not process your request.", "We encountered an error while loading the page.", "Unexpected server error", "Internal error, please try again later.", "The request could not be processed due to an internal error.",
        "Service temporarily unavailable", "The site is down for maintenance, please check back later.", "We are working on it and will be back shortly.", "Server is overloaded, try again in a few minutes.", "The upstream server closed the connection.", "The server did not send any data.", "The connection was refused by the server.", "Unable to load this page.", "Failed to fetch the content, check your network connection.", "Loading failed, tap to try again.",
        "You do not have access to this page.", "Sorry, you are not allowed to view this content.", "Access to this site is blocked.", "You don't have permission to open this document.", "Request access from the owner.", "This account is private.", "Please log in to view this page.", "Sign in to continue.", "You must be signed in to read this document.", "Your login session has expired.", "Please sign in again.", "Members only: log in to continue reading.",
        "Too many requests from your address.", "You have reached the request limit, wait a minute and try again.", "API limit exceeded", "Please wait while we verify your browser.", "Please verify that you are not a robot.", "Checking if the site connection is secure", "Automated access to this page was denied.", "Invalid request, please try again.",
        "Die Seite existiert nicht.", "Diese Seite ist nicht mehr verfügbar.", "Der Zugriff wurde verweigert.", "Der Server antwortet nicht, bitte später erneut versuchen.", "您要查看的页面已被删除", "服务器内部错误", "没有访问权限", "网络错误,请重试",
    ],
    "template": [
        "Dear {name}, your order has been shipped.", "Hello {{first_name}},", "Hi [Name],", "Thank you for contacting [Company Name].", "${title}", "{{ content }}", "{% block body %}", "<%= user.email %>", "[INSERT LOGO HERE]", "[[PAGE_TITLE]]", "%%EMAIL%%", "<enter your address>", "Insert a title here.", "Put your text here.", "Add a summary here.", "Write your text here.",
        "This is example text.", "Replace this paragraph with your text.", "Edit or delete this sample page.", "Placeholder content", "Please fill in the description.", "Coming soon!", "This page is being built.", "This section is left blank.", "Bitte Text einfügen.", "Beispieltext", "请输入内容", "网站正在建设中",
    ],
    "filler": ["Lorem ipsum dolor sit amet consectetur", "Excepteur sint occaecat cupidatat non proident.", "Nemo enim ipsam voluptatem quia voluptas.", "blah blah blah blah blah", "test test test test", "TODO TODO TODO TODO", "asdf asdf asdf asdf"],
}

LAST_GENUINE = [
    "The committee found no error in the accounts and approved them on Friday.", "A page of the ledger was missing, so the total could not be checked.", "The server room is on the third floor, next to the kitchen.", "We loaded the truck twice and still had boxes left.", "Access to the roof is for members of the club who hold a key.",
    "Her request for leave was denied because the season had begun.", "The site of the old mill is now a car park.", "Each script was read aloud before the actors chose their parts.", "He logged in at noon, fixed the table and logged out again.", "The connection between the two rivers was dug in 1820.", "The template for the stencil is cut from thick card.",
    "Text and image stand on facing pages in the second edition.", "The test is repeated until two results agree.", "The sample was kept at four degrees until it was measured.", "Please read the notes before you change the default of this option.", "The browser history showed that nobody had opened the report.", "A moment later the light went out and the lift stopped.", "The content of sugar is printed on the back of the box.",
    "We will be back in the office on the second of January.", "The owner of the boat asked for a new sail.",
]
